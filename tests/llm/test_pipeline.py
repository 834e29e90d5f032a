"""The pipeline against stage-by-stage brute force, and the registered queries."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from seine.llm import pii, queries, quality_model
from seine.llm.tables import texts
from tests.llm.test_near_texts import kept_by_brute_force
from tests.llm.test_ten_operators import brute_terms, hostile


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data).cache()
        out.append(docs.collect())
    return out


def test_columns_and_order(spark, data, stages):
    want = spark.read.parquet(f"{data}/documents.parquet").columns
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == want
    sizes = [len(r) for r in stages[:-1]]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]


def test_quality_stage(spark, data, stages):
    model = quality_model.train(texts(spark.read.parquet(f"{data}/documents.parquet")))
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0] if quality_model.score(r["text"], model["weights"]) >= 0.5}


def test_line_stage(stages):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for r in stages[1]:
        for x in r["text"].split("\n"):
            holders[key(x)].add(r["doc_id"])
    after = {r["doc_id"]: r["text"] for r in stages[2]}
    for r in stages[1]:
        kept = [x for x in r["text"].split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or r["doc_id"] == max(holders[key(x)])]
        assert after[r["doc_id"]] == "\n".join(kept)


def test_near_dedup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    assert [i for i, _ in sorted(kept_by_brute_force(rows))] == sorted(r["doc_id"] for r in stages[3])


def test_sanitise_stage(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[3]]
    spans = dict(brute_terms(before))
    assert any("term_" in s for s in spans.values())
    after = {r["doc_id"]: r["text"] for r in stages[4]}
    for i, text in before:
        terms = [(int(a), kind[5:], int(b)) for kind, a, b in (x.split(":") for x in spans[i].split(",") if x) if kind.startswith("term_")]
        assert after[i] == pii.redact(text, [{"start": a, "action": action, "end": b} for a, action, b in terms])
        assert not pii.base_spans(after[i])


HOSTILE = "doc_id long, text string, lang string, source string, n_chars long, _seine_id string, th string, node long, part int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_takes_hostile_and_empty_tables(spark, data, name, stage):
    rows = [(r[0], r[1], None, r[3], None, "x", "y", 1, 2) for r in hostile()]
    docs = spark.createDataFrame(rows, HOSTILE).repartition(3)
    found, empty = stage(spark, docs, data), stage(spark, docs.limit(0), data)
    assert empty.count() == 0
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        return
    assert found.columns == empty.columns == docs.columns
    held = collections.Counter((r[0], r[2:]) for r in rows)
    kept = collections.Counter((r[0], tuple(r)[2:]) for r in found.collect())
    assert not kept - held and (kept or name == "quality classifier")  # hostile texts are poor ones
    if name in ("line dedup", "PII"):
        assert kept == held
    if name == "SimHash near-dedup":
        assert {r["doc_id"] for r in docs.where("doc_id is null").collect()} <= {i for i, _ in kept}


def test_pack_stage(spark, data, stages):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encoder, want = Tokenizer.from_file(path("word_bpe_49k.json")), set()
    for r in stages[4]:
        ids = np.array(encoder.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        want |= {(r["doc_id"], k, zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[5]} == want
    whole = corpus_pipeline.run(spark, data).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole} == want


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    found = queries.QUERIES[name](spark, data).toPandas()
    assert sorted(found.columns) == sorted(want.columns)
    digest = lambda df: sorted(hashlib.md5(repr([None if v != v else v for v in map(lambda x: x.item() if hasattr(x, "item") else x, r)]).encode()).hexdigest() for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    text = lambda df: df.astype(object).where(df.notna(), None).map(lambda v: None if v is None else str(int(v)) if isinstance(v, (float, np.floating, np.integer)) and float(v).is_integer() else str(v))
    assert digest(text(found)) == digest(text(want))
