"""The registered queries: columns of the contract, one row per document or page, and SQL where there is some."""

import hashlib
import os
import zlib

import duckdb
import pytest

from keyloom.llm import queries as llm
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op9_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, tables, name):
    df = llm.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {k: kinds.get(k) for k in kinds if f"{k} " in COLUMNS[name] + " "} == dict(x.split() for x in COLUMNS[name].split(", "))
    table, key = ("pages", "page_id") if name.startswith("op8") else ("documents", "doc_id")
    ids = sorted(x[0] for x in tables.execute(f"SELECT {key} FROM {table}").fetchall())
    rows = df.collect()
    got = sorted({r[key] for r in rows}) if name.startswith("op6") else sorted(r[key] for r in rows)
    assert got == ids
    if "held_out" in kinds:
        fold = {"op1_toxicity": (3, 1), "op3_language_id": (4, 2)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_equals_sql(spark, tables, name):
    df = llm.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(str(r[c]) for c in names) for r in df.collect()))
    found = tables.execute(f"SELECT {', '.join(names)} FROM ({llm.ORACLE[name]})").fetchall()
    assert got == sorted(tuple(str(x) for x in r) for r in found)


def test_secrets_of_the_table(spark, tables):
    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    kinds = ("assign", "access", "hex")
    for r in llm.op5_secret_scans(spark, SF).collect():
        spans = brute.base_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert {f"{kinds[k]}:{a}:{b}" for a, k, b in spans} <= set(r.spans.split(","))


def test_accuracy_on_the_table(spark, tables):
    lang = dict(tables.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    held = [r for r in llm.op3_language_id(spark, SF).collect() if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
