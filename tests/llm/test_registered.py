import base64
import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from palaver.llm import queries
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


def test_names():
    names = list(queries.queries())
    assert sorted(n.split("_")[0] for n in names if n != "pipeline") == sorted(f"op{k}" for k in range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    assert same(spark, FOLDER, queries.queries()[name], queries.oracle_sql()[name], connect(FOLDER)) > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    types = dict(queries.queries()[name](spark, FOLDER).dtypes)
    assert {k: types.get(k) for k in COLUMNS[name]} == COLUMNS[name]


def test_warc_of_the_table(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"], p["page_id"])
    want = {p["page_id"]: (len(p["html"].encode()), base64.b32encode(hashlib.sha1(p["html"].encode()).digest()).decode(), None if first[p["html"]] == p["page_id"] else first[p["html"]]) for p in pages}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in queries.queries()["op2_warc"](spark, FOLDER).collect()}
    assert got == want


def test_packing_of_the_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    ids = {i: np.array(encoder.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in docs.items()}
    rows = queries.queries()["op3_packing"](spark, FOLDER).collect()
    covered = dict.fromkeys(ids, 0)
    for r in rows:
        covered[r.doc_id] += r.length
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert covered == {i: len(x) for i, x in ids.items()} and len({r.sequence_id for r in rows}) == len(rows)
