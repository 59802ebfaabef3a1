"""Work that grew faster than the table."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumaspec.llm import bwt, suffix_dedup


def group(g, texts):
    return pa.table({"g": [g] * len(texts), "doc_id": [g * len(texts) + i for i in range(len(texts))], "text": [t.encode() for t in texts], "text_hash": [0] * len(texts)})


def test_f1_short_repeats_send_no_strings():
    """Phrases of 20 bytes that stand in all documents, in other surroundings: no window repeats, so nothing is sent to be merged."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [word(20) for _ in range(40)]
    groups = [group(g, ["".join(p + word(31) for p in rng.sample(phrases, 40)) for _ in range(5)]) for g in range(4)]
    told = suffix_dedup._repeated(pa.concat_tables(suffix_dedup._announce(1)(t) for t in groups))
    assert sum(suffix_dedup._submit(1)(t, told.filter(pc.field("g") == g)).num_rows for g, t in enumerate(groups)) == 0


def test_f1_messages_for_a_group_and_its_share_of_buckets():
    """Of hashes and of strings, the buckets are no more than the groups."""
    assert [suffix_dedup.key_buckets(n) for n in (1, 4, 5, 2_550)] == [1, 1, 2, 638]
    assert [suffix_dedup.string_buckets(n) for n in (1, 5, 2_550)] == [1, 5, 2_550]


def test_f1_only_ends_of_windows_enter_the_interleave(monkeypatch):
    """A suffix with fewer than ``depth`` symbols before it leads to no window; the others are refined from the start."""
    rng = random.Random(4)
    strings = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randint(3, 30))).encode() for _ in range(200)))
    sizes = [len(s) for s in strings]
    entered, merge = [], bwt.merge
    monkeypatch.setattr(bwt, "merge", lambda t, longer, depth: (entered.append(sum(int((x >= 0).sum()) for x in longer)), merge(t, longer, depth))[1])
    owners = np.array([rng.randrange(1000) for _ in strings])
    got, windows = bwt.least_owners(strings, owners, 12, [50, 0, len(strings) - 50])
    least = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - 11):
            least[s[i : i + 12]] = min(least.get(s[i : i + 12], 9999), o)
    assert got.tolist() == [least[s[i : i + 12]] for s in strings for i in range(len(s) - 11)]
    assert entered == [sum(max(0, n - 11) for n in sizes)] and windows.sum() == entered[0]
