"""Language codes, filter interactions and token alignment against brute force, with awkward and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, interactions, langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, `a.b` int"
AWKWARD = [(1, None), (None, "a null id"), (2, ""), (3, "\n\n \n"), (4, "x" * 5000), (6, "repeat me"), (6, "repeat me"), (7, "İSTANBUL ẞ 日本語 👍 \x00 end"), (8, "▁ blank"), (9, "12 $ 34")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(None, None)[len(r) - 2 :], 3, 4) if len(r) < 4 else (*r, 3, 4) for r in rows], SCHEMA)


# op11


def coded(counts, langs, text):
    """Code lengths by walking one byte after another."""
    data = b"\n" * langid.ORDER + "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    out = []
    for lang in langs:
        total = 0
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER, -1, -1):
                seen = counts.get((lang, data[i - k : i]))
                if seen:
                    share = sum(seen.values()) + len(seen)
                    if seen[data[i]]:
                        total += round(-math.log2(seen[data[i]] / share) * (1 << langid.UNIT))
                        break
                    total += round(-math.log2(len(seen) / share) * (1 << langid.UNIT))
            else:
                total += 8 << langid.UNIT
        out.append(total)
    return out


def trained(rows, langs, **bounds):
    lang, gram = [], []
    for name, text in rows:
        found = langid.grams(*langid.padded(pa.array([text], pa.large_string())))
        gram.append(found)
        lang.append(np.full(len(found), langs.index(name)))
    gram = np.concatenate(gram)
    return langid.build(langs, np.concatenate(lang), gram, np.ones(len(gram), np.int64), **bounds)


def test_code_lengths_equal_a_walk_over_bytes(monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdéAz \n") for _ in range(n))
    langs = ["x", "y", "z"]
    rows = [(rng.choice(langs), text(rng.randint(0, 60))) for _ in range(40)]
    counts = collections.defaultdict(collections.Counter)
    for lang, t in rows:
        data = b"\n" * langid.ORDER + "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode()
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER + 1):
                counts[lang, data[i - k : i]][data[i]] += 1
    texts = [text(rng.randint(0, 50)) + rng.choice(["", "qü"]) for _ in range(40)] + ["", "日本語"]
    model = trained(rows, langs)
    want = [coded(counts, langs, t) for t in texts]
    assert model.lengths(pa.array(texts, pa.large_string())).tolist() == want
    monkeypatch.setattr(langid, "BLOCK", 1)  # any cut into blocks adds up alike
    assert model.lengths(pa.array([*texts, "ab" * 9000], pa.large_string())).tolist()[:-1] == want


def test_a_bounded_tree_keeps_what_contexts_end_in():
    rng = random.Random(4)
    rows = [("x", "".join(rng.choice("abcde ") for _ in range(300))) for _ in range(9)]
    model = trained(rows, ["x"], nodes=40)
    assert len(model.escape) == 40 and model.child.max() == 39
    assert len(np.unique(model.child[model.child > 0])) == 39  # each context but the empty one hangs below the one it ends in
    assert trained(rows, ["x"], most_costs=30).cost.shape[0] <= 31
    assert model.lengths(pa.array(["abc zzz"], pa.large_string()))[0, 0] > 0


def test_language_of_held_out_and_awkward_rows(spark):
    rng = random.Random(6)
    stems = {"nu": ["tak", "pol", "zim"], "va": ["ela", "ouri", "ienne"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randint(3, 30))), lang, "s") for i in range(200) for lang in (rng.choice(["nu", "va"]),)]
    docs = frame(spark, [*rows, *AWKWARD])
    out = langid.predict(docs, langid.fit(docs, ~langid.held_out()))
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r.doc_id].add((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert out.count() == len(rows) + len(AWKWARD) and out.columns == ["doc_id", "lang_pred", "score"]
    right = [any(p == r[2] for p, _ in got[r[0]]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(right) > 40 and all(right)
    bare = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, AWKWARD), langid.fit(docs)).collect()}
    assert bare[1] == bare[2] == bare[3] == bare[9] == ("und", 0.0) and bare[7][0] in ("nu", "va")


def test_language_never_learns_from_held_out_rows(spark):
    rows = [(i, "lorem ipsum" if zlib.crc32(str(i).encode()) % 3 == 1 else "dolor sit", "held" if zlib.crc32(str(i).encode()) % 3 == 1 else "seen", "s") for i in range(30)]
    docs = frame(spark, rows)
    assert langid.fit(docs, ~langid.held_out()).langs == ["seen"]
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs, ~langid.held_out())).collect()} == {"seen"}


def test_language_of_nothing(spark):
    empty = frame(spark, [])
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(frame(spark, AWKWARD), None).collect()} == {("und", 0.0)}


# op12


def audited(rows, labels):
    """Every order by applying its filters to the rows, one after another."""
    words = lambda t: [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
    facts = collections.defaultdict(list)
    for i, t, _, s in rows:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        mine = [(q, x) for j, q, x in labels if j == i and i is not None]
        facts[s or ""].append(({k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, shapley = {}, collections.Counter()
    for part, own in facts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                early = sum(f in x[0] and bool(x[0] & set(order[: step - 1])) for x in own)
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), early, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions_equal_filters_applied_in_every_order(spark):
    rng = random.Random(8)
    texts = ["", "AB cd", "a b c $", "x " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}#" for i in range(220)), "\x1f one\x0btwo\x85 three", "É ß 日本"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([*texts, None]), "en", rng.choice(["p", "q", None, ""])) for _ in range(90)]
    rows += rows[:4]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    out = interactions.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert got == audited(rows, labels)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "string", "int", *["bigint"] * 7]


def test_interactions_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(frame(spark, []), none).count() == 0
    rows = [(*r, "en", "s") for r in AWKWARD]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interactions.audit(frame(spark, rows), none).collect()} == audited(rows, [])


def test_parity_sums_invert_to_the_cells(spark):
    rng = random.Random(9)
    cells = [("p", rng.random() < 0.5, rng.random() < 0.5, m, rng.randint(1, 9)) for m in range(32) for _ in range(2)]
    sums = interactions.parity_sums(spark.createDataFrame(cells, "part string, good boolean, toxic boolean, mask int, n long"))
    got = interactions.inverted(sums).first()
    for kind, i in (("all", None), ("good", 1), ("toxic", 2)):
        assert got[kind] == [sum(c[4] for c in cells if c[3] == m and (i is None or c[i])) for m in range(32)]


# op13


@pytest.fixture(scope="module")
def files():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def aligned(texts, both):
    """Whole texts by the libraries, groups and links by walking both lists of ends."""
    rows, count = [], collections.Counter()
    for t in texts:
        rows.append(None)
        if not t:
            continue
        a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
        parts = [[both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]]
        if any(b"".join(p) != (" " + t).encode() for p in parts):
            continue
        a_end, b_end = (list(itertools.accumulate(map(len, p))) for p in parts)
        cut = set(a_end) & set(b_end)

        def groups(ids, ends, cut=cut):
            out = [[]]
            for i, e in zip(ids, ends, strict=True):
                out[-1].append(str(i))
                if e in cut:
                    out.append([])
            return [",".join(g) for g in out[:-1]]

        said = ["|".join(x) for x in zip(groups(a, a_end), groups(b, b_end), strict=True)]
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            i, j = i + (a_end[i] <= b_end[j]), j + (b_end[j] <= a_end[i])
        count.update(links)
        rows[-1] = (len(a), len(b), len(said), links, hashlib.sha256(";".join(said).encode()).hexdigest())
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in rows], count


ALPHABET = ["a", "b", "the", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", ".", ",", "'s", "'", "don't", "1", "23", "漢", "字", "🙂", "<s>", "<|endoftext|>", "\x00", "\x1f", "\x85", "$$", "|", "<0x0A>", "ÀB", "﻿", "ﬁ", "(", ")", "//", ");\r", "_"]


def test_units_give_the_tokens_of_whole_texts(files):
    both, rng = alignment._tokenizers(*files), random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40)))
        units = [u for part in both.units(text) for u in part]
        a, b = both.encode(units)
        assert "".join(units) == " " + text
        assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids and sum(b, []) == both.b.encode(text), text


def test_alignment_equals_brute_force(spark, files):
    rng = random.Random(12)
    texts = ["".join(rng.choice([*ALPHABET, "▁"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", " ", "\n", "ab" * 3000, "🙂" * 500, " " * 300, "x" * 2000, "▁", "a\n", *(t for _, t in AWKWARD)]
    want, count = aligned(texts, alignment._tokenizers(*files))
    docs = frame(spark, list(enumerate(texts))).repartition(3)
    for sift in (True, False):  # without sifting, the check of bytes finds what has no tokens
        out, pairs = alignment.align(docs, *files, sift=sift)
        assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == dict(enumerate(want))
        assert {(r.a_id, r.b_id): r.pairs for r in pairs.collect()} == count


def test_alignment_of_odd_ids_and_nothing(spark, files):
    rows = [(None, "one two"), (5, "one two"), (5, "one two"), (6, "three. four"), (7, None)]
    want, _ = aligned([t for _, t in rows], alignment._tokenizers(*files))
    out, _ = alignment.align(frame(spark, rows), *files)
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(want) and out.schema["doc_id"].dataType.simpleString() == "bigint"
    texts = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id")))
    assert alignment.align(texts, *files)[0].where("doc_id = 'id5'").count() == 2
    assert alignment.align(frame(spark, []), *files)[0].count() == 0


def test_texts_stay_whole_where_pieces_cross_blanks():
    assert alignment.cuts(["a", "b▁c"]).findall(" x y") == [" x y"]
    assert alignment.cuts(["a.", "▁b"]).findall(" a. b, c\nd") == [" a.", " b", ",", " c", "\n", "d"]
