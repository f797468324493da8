import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from opslens.llm import suffix_dedup as sd


def windows(texts, width):
    return Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))


def by_hand(rows, width=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = windows([t for _, t in texts], width)
    out = []
    for i, text in texts:
        gone = bytearray(len(text))
        for at in range(len(text) - width + 1):
            if counts[text[at:at + width]] > 1:
                gone[at:at + width] = b"x" * width
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(1 for at in range(len(gone)) if gone[at] and (not at or not gone[at - 1]))
        out.append((i, len(text), sum(map(bool, gone)), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("letters, width", [(b"ab", 3), (b"abcd", 5), (b"abcdefgh", 2), (b"a", 4), (bytes(range(1, 240)), 1)])
def test_transform_equals_counting(letters, width):
    rng = random.Random(width)
    for _ in range(60):
        strings = list(dict.fromkeys(bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 25))))
        counts, flags = windows(strings, width), sd.Transform(strings, width).repeated(width)
        for row, string in enumerate(strings):
            expected = [counts[string[i:i + width]] > 1 for i in range(len(string) - width + 1)]
            assert flags[row][:len(expected)].tolist() == expected and not flags[row][len(expected):].any()


def test_transform_is_the_sorted_one():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    built = sd.Transform(strings, 100)
    suffixes = sorted(((s[i:], k, s[i - 1:i] if i else b"") for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: (x[0] + b"\0", x[1]))
    letters = sorted(set(b"".join(strings)))
    assert built.symbols().tolist() == [letters.index(before[0]) + 1 if before else 0 for _, _, before in suffixes]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert (built.rows[1:built.size] >> 8).tolist() == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


def test_equal_parts_are_inserted_once(monkeypatch):
    rng = random.Random(21)
    passage, other = (words(rng, 120).encode() for _ in range(2))
    strings = [bytes([k]) * 50 + passage + bytes([k]) * 50 for k in range(1, 13)]
    strings += [passage[30:] + words(rng, 9).encode(), other, b"-" + other, words(rng, 200).encode()]
    inserted = []

    class Seen(sd.Transform):
        def __init__(self, parts, most):
            inserted.extend(parts)
            super().__init__(parts, most)

    monkeypatch.setattr(sd, "Transform", Seen)
    frame = pd.DataFrame({"name": 5, "digest": range(len(strings)), "n": 1, "string": strings})
    marked = {(r.digest, at) for r in sd.grouped_marks(frame, 400).itertuples() for at in range(r.low, r.high)}
    counts = windows(strings, 400)
    assert marked == {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 399) if counts[s[i:i + 400]] > 1}
    assert len(inserted) == len(set(inserted)) < 6
    parts = [passage[:450], passage[:430], passage[:450], other[:500]]  # the second is no copy, but its windows stand in the others
    assert [np.flatnonzero(row).tolist() for row in sd.repeated_in(parts, 400)] == [list(range(n)) for n in (51, 31, 51, 0)]


def test_equal_windows_have_equal_names():
    rng = random.Random(3)
    shared = words(rng, 200).encode()
    texts = [words(rng, 40).encode() + shared + words(rng, 30).encode(), shared[100:] + words(rng, 50).encode(), b"ab" * 900, b"b" + b"ab" * 700]
    for step in (None, 16, 1):
        names = {}
        for text in texts:
            for starts, counts, name, _, places in sd.strings_of(text, 400, 200):
                assert counts.max() <= 201 and (places >= 1).all()
                for start, count, n in zip(starts.tolist(), counts.tolist(), name.tolist()):
                    pieces = [(0, count, n, 0)] if step is None else list(sd.pieces_of(text[start:start + count + 399], 400, 200, step))
                    assert sum(p[1] for p in pieces) == count
                    for at, size, piece, _ in pieces:
                        for w in range(start + at, start + at + size):
                            names.setdefault(text[w:w + 400], set()).add(piece)
        assert all(len(found) == 1 for found in names.values())


def corpus():
    rng = random.Random(17)
    passage, line = words(rng, 120), words(rng, 90)
    rows = [(i, words(rng, rng.randint(30, 300))) for i in range(25)]
    rows += [(100 + i, words(rng, 40) + passage + words(rng, 60)) for i in range(12)]  # one passage between different texts
    rows += [(200 + i, f"{i} " + line) for i in range(9)]  # the same but for the first characters
    base = words(rng, 400).split(" ")
    for i in range(8):  # near copies
        copy = list(base)
        copy[rng.randrange(400)] = "changed"
        rows.append((300 + i, " ".join(copy)))
    rows += [(400, "ab" * 600), (401, "x" * 399), (402, "y" * 400), (403, "z" * 401), (404, None), (405, ""), (None, rows[0][1]), (7, rows[7][1])]
    rows += [(500, "\n".join([words(rng, 3) + line] * 4)), (501, "é" * 450)]  # repeated inside itself
    return rows


@pytest.mark.parametrize("most, group_bytes", [(1000, 600_000), (3, 600_000), (1, 600_000), (1000, 3_000)])
def test_query_equals_counting(spark, documents, sf, monkeypatch, most, group_bytes):
    monkeypatch.setattr(sd, "GROUP_BYTES", group_bytes)
    rows = corpus()
    docs = documents(*rows).repartition(4)
    done = sd.cut(docs.select("doc_id", "text"), most=most)
    got = done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)


def test_op_query(spark, documents, sf):
    rows = corpus()
    got = sd.op13_suffix_dedup(spark, sf(documents=documents(*rows)))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def test_slices_of_a_long_text(spark, documents, monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 500)
    rng = random.Random(5)
    shared = words(rng, 300)
    rows = [(1, words(rng, 2000) + shared), (2, shared + words(rng, 1500)), (3, words(rng, 800))]
    done = sd.cut(documents(*rows).select("doc_id", "text")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, done.collect()), key=repr) == by_hand(rows)


def test_texts_without_repeats_clashing_names_and_empty_table(spark, documents):
    rng = random.Random(8)
    shared = words(rng, 100)
    df = spark.createDataFrame([(1, "one " + shared, "a", 1.5, 9), (2, "two " + shared, "b", None, 8), (3, "short", "c", 2.5, 7), (4, None, None, None, None)],
                               "doc_id LONG, text STRING, row STRING, `spans.n` DOUBLE, n LONG")
    kept = {r["doc_id"]: r.asDict() for r in sd.kept_texts(df).collect()}
    assert list(kept[1]) == df.columns and (kept[1]["row"], kept[2]["spans.n"], kept[1]["n"]) == ("a", None, 9)
    assert kept[3]["text"] == "short" and kept[4]["text"] is None and len(kept[1]["text"]) < 10
    assert sd.cut(df.limit(0)).collect() == []
