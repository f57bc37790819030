"""Every operator's query and the pipeline on a small table with odd rows: columns, rows and what must hold of each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import common, mixing
from pathloom.llm.registry import ORACLES, QUERIES

PLANE = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, score double, start long, shard int, turn long, part int, _range int"
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_exact": "doc_id keep_id group_size kept text_sha256",
    "op4_iblt": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_orc_tokens": "doc_id start n_tokens ids_crc32",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_suffix": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_mixing": "doc_id domain lang source tokens epoch",
    "op11_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op13_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}
#: Queries with one row a document.
EACH = ("op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op8_", "op9_", "op12_")


def odd_documents() -> list[tuple]:
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdgmt" for b in "aeio" for c in ("n", "rs", "ll", "")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(3, 90)) + "." for _ in range(40)]
    texts += [None, "", "   ", "x", texts[0], texts[0].upper(), texts[1] + " more", "é\U0001f600 " * 30, "password = abcdefghijkl12345", "under the MIT license", prose(300_000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src3", "src12", None])) for i, t in enumerate(texts)]
    rows += [(2, "another text of number two", "en", "src0"), (2, texts[2], "en", "src0"), (None, texts[5], "de", "src0"), (None, None, None, None), rows[3], rows[3]]
    return [(i, t, lang, source, None if t is None else len(t), "k", 1, 0.5, 7, 3, 1, 2, 9) for i, t, lang, source in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with odd rows, and one of empty tables."""
    full, none = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("none")
    docs = spark.createDataFrame(odd_documents(), PLANE)
    labels = spark.createDataFrame([(i, i % 3 == 0, int(i % 4 == 1)) for i in range(0, 30)] + [(None, True, 1), (31, None, None)], "doc_id long, quality boolean, toxic int")
    talk = spark.createDataFrame([(c, t, r, x, "s", 4) for c in (1, 2, None) for t, r, x in ((1, "user", "Hi."), (2, "assistant", "Yes"), (None, None, None), (2, "tool", ""))], "conv_id long, turn long, role string, text string, signature string, seq int")
    points = spark.createDataFrame([(i, i % 3, [float(i % 7), 1.0, -0.5 * (i % 3)], "n") for i in range(120)] + [(50, 1, None, "n"), (100, None, [1.0], "n"), (150, 1, [None, 1.0], "n")], "vec_id long, label int, embedding array<float>, norm string")
    for name, table in (("documents", docs), ("labels", labels), ("conversations", talk), ("embeddings", points)):
        table.repartition(3).write.parquet(f"{full}/{name}.parquet")
        table.limit(0).write.parquet(f"{none}/{name}.parquet")
    return str(full), str(none)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_odd_rows(spark, odd, name):
    full, none = odd
    found = QUERIES[name](spark, full)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = found.collect()
    if name.startswith(EACH):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in odd_documents())
    elif name == "op7_packing":
        pieces = {(r.doc_id, r.start) for r in rows}
        assert pieces and sum(r.length for r in rows) > 300_000
    else:
        assert rows
    assert QUERIES[name](spark, none).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    full, none = odd
    docs = common.documents(spark, full)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, full)
        assert kept.columns == common.DOCUMENT_COLUMNS, name
        assert kept.select(F.count("*")).first()[0] > 0
    assert corpus_pipeline.run(spark, full).count() > 0
    assert corpus_pipeline.run(spark, none).count() == 0
    assert set(ORACLES) <= set(QUERIES) and mixing.SEED == 17
