"""Nearest neighbours by brute force; the pipeline's stages and contract."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import ann


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_ann_recall_scores_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    df = vectors(spark, x)
    got = ann.search(df, df.where("vec_id % 20 = 0"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert len(by) == 75 and all(sorted(r.rank for r in rs) == list(range(1, 21)) for rs in by.values())
    hits = 0
    for q, rs in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in rs} & set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()))
        assert all(abs(r.score - x[r.vec_id] @ x[q]) < 1e-9 for r in rs)
        ordered = sorted(rs, key=lambda r: r.rank)
        assert [r.vec_id for r in ordered] == [r.vec_id for r in sorted(rs, key=lambda r: (-r.score, r.vec_id))]
    assert hits / (75 * 20) >= 0.97


def test_ann_many_blocks_agree_with_one(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(400, 8))
    df = vectors(spark, x)
    one = {tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0"), 5).collect()}
    monkeypatch.setattr(ann, "ROWS_BLOCK", 60)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert {tuple(r)[:3] for r in ann.search(df, df.where("vec_id % 20 = 0"), 5).collect()} == {r[:3] for r in one}


def test_ann_copies_of_a_vector_push_out_no_other():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    x[1::3] = 1.3 * x[1]
    book = ann.Codebook.fit(x)
    codes = pa.array([c.tobytes() for c in book.pack(book.encode(x))], pa.binary())
    data = pa.table({"vec_id": pa.array(np.arange(len(x))), "v": pa.array(list(x)), "code": codes})
    got = ann._meet(book, 20)(None, data, data.select(["vec_id", "v"]).append_column("nth", data["vec_id"]).take(np.arange(0, len(x), 5))).to_pydict()
    for i in range(0, len(x), 5):
        s = x @ x[i]
        s[1::3] = s[1]
        s[i] = -np.inf
        true = set(np.lexsort((np.arange(len(x)), -s))[:20].tolist())
        assert len(true & {v for q, v in zip(got["query_id"], got["vec_id"], strict=True) if q == i}) >= 19, i


def test_ann_repeated_rows_equal_brute_force(spark, monkeypatch):
    """Equal rows of an id are one query, unequal ones are two; candidates stand as often as their rows do."""
    monkeypatch.setattr(ann, "ROWS_BLOCK", 30)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6)).round(2)
    ids = [*range(100), *range(0, 60, 3)]
    x[100:110] = x[0:30:3]  # rows 0, 3 .. 27 stand twice; those of 30, 33 .. 57 have another vector
    df = vectors(spark, x, ids)
    got = {}
    for r in ann.search(df, df.where("vec_id % 15 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {}
    for i, v in {(i, tuple(v)) for i, v in zip(ids, x.tolist(), strict=True) if i % 15 == 0}:
        near = sorted((-float(np.dot(u, v)), j) for j, u in zip(ids, x, strict=True) if j != i)[:7]
        want.setdefault(i, []).extend((n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(got[30]) == 14 and len(got[0]) == 7


def test_ann_ties_bad_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, df.where("vec_id in (0, 4, 5)"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 3, 1.0)]
    assert ann.search(df.limit(0), df, 3).count() == 0


def test_anisotropic_codes_lose_less_along_the_vector(monkeypatch):
    x = np.random.default_rng(4).normal(size=(2000, 48))
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def decoded():
        book = ann.Codebook.fit(x)
        codes = book.encode(x)
        back = np.concatenate([book.centers[m][codes[:, m]] for m in range(codes.shape[1])], 1)
        return book, codes, back, (((x - back) * unit).sum(1) ** 2).mean()

    book, codes, back, along = decoded()
    sums, tables = np.zeros(len(x)), book.tables(x[:1])[0]
    for m, b in enumerate(book.pack(codes).T):
        sums += tables[m, b]
    assert np.allclose(sums, back @ x[0], atol=1e-4)
    monkeypatch.setattr(ann, "THRESHOLD", 0.0)
    plain = decoded()
    assert book.weight > 0 == plain[0].weight and along < 0.8 * plain[3]


def test_pipeline_contract(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = p.run(spark, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r.round_trip and len(r.token_ids) == r.n_tokens for r in rows)


def test_pipeline_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, schema in (("documents", none.schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = none
    for _, f in p.STAGES:
        docs = f(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns[:5] == none.columns


def test_columns_that_clash_stay_and_do_not_crash(spark, tmp_path):
    import corpus_pipeline as p

    shared = "one line of a passage\nand the one behind it"
    rows = [(1, shared, "k1", "r1", 7, "t", True), (2, f"own\n{shared}", "k2", "r2", 8, "u", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _runs string, n_tokens long, Token_Ids string, round_trip boolean")
    kept = p.dedup_lines(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], (2, "own", *rows[1][2:])]
    out = p.tokenize(spark, kept, str(tmp_path))
    assert out.columns == [*docs.columns, "n_tokens_2", "token_ids_2", "round_trip_2"]
    found = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[2:7] for r in found] == [r[2:] for r in rows]
    assert all(r.round_trip_2 and r.n_tokens_2 == len(r.token_ids_2) > 0 for r in found)


def test_every_stage_takes_clashing_and_dotted_names(spark, tmp_path):
    import corpus_pipeline as p

    names = ["_key", "_runs", "_lines", "_removed", "a.b", "key", "node", "root", "bucket", "nth", "score", "n_tokens", "token_ids", "round_trip"]
    rows = [(i, f"text {i % 2} of a few words that say nothing of note here") for i in range(4)] + [(None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "other")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, f in p.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert {tuple(r)[2 : len(docs.columns)] for r in out.collect()} <= {tuple(names)}, name


def test_registered_queries_of_operators(spark, sf_dir):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in names:
        if name not in ("op5_ann", "op12_filter_interactions"):
            assert e.queries()[name](spark, sf_dir).agg(F.count("*")).first()[0] == n, name
