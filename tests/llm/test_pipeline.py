"""The pipeline against a plain version of its five stages."""

import collections
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sylvan.llm import exact_dedup, jaccard_join, pii, toxicity


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrstlmou") for _ in range(rng.randint(3, 8)))
    out = []
    for i in range(240):
        w = [word() for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            w[rng.randrange(len(w))] = "moronic"
        if i % 11 == 0:
            w[rng.randrange(len(w))] = f"mail{i}@ex.org"
        out.append((i, " ".join(w)))
    out += [(300, out[5][1].upper()), (301, out[5][1]), (302, out[8][1] + " tail"), (303, out[8][1] + " end"), (304, None), (305, ""), (None, out[9][1]), (None, None), (306, out[10][1] * 40)]
    out += [out[13], out[14], out[14]]
    return [(i, t, "en", "web", len(t or ""), 5) for i, t in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("moronic" in (r[1] or ""))) for r in data[:240]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def plain_copies(data):
    """Of equal texts the largest doc_id, once."""
    best = {}
    for r in data:
        k = lower(r[1])
        if k not in best or (best[k][0] is None and r[0] is not None) or (None not in (r[0], best[k][0]) and r[0] > best[k][0]):
            best[k] = r
    return list(best.values())


def plain_near(data):
    """Rows whose doc_id is the smallest of its component."""
    sets = collections.defaultdict(set)
    for r in data:
        w = lower(r[1]).encode().split()
        if r[0] is not None and w:
            sets[r[0]] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    low = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = {k: x if v == y else v for k, v in low.items()}
    return [r for r in data if low.get(r[0], r[0]) == r[0]]


def test_run_equals_a_plain_version(spark, folder):
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, labels)
    data = [tuple(r) for r in docs.collect()]
    score = model.score([model.margin(x) for x in toxicity.Features().batch([r[1] or "" for r in data])])
    clean = [r for r, s in zip(data, score, strict=True) if s < 0.7]
    assert 20 <= len(data) - len(clean) <= 60 and sum("moronic" in (r[1] or "") for r in clean) <= 10
    left = plain_near(plain_copies(clean))
    assert len(left) < len(clean)
    # What the PII stage writes for each text is tested beside it; here its rows are those of the stage before.
    safe = pii.sanitised(spark.createDataFrame(left, SCHEMA))
    assert safe.columns == docs.columns
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in safe.collect())
    got = corpus_pipeline.run(spark, folder)
    pieces = got.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {(r.doc_id, r.doc_tokens): r.n for r in pieces} == {k: k[1] * n for k, n in want.items()}
    assert not safe.where("text LIKE '%@ex.org%'").count()


def test_stages_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    data = [tuple(r) for r in docs.collect()]
    assert collections.Counter(map(tuple, exact_dedup.without_copies(docs).select("doc_id", F.lower(F.coalesce("text", F.lit("")))).collect())) == collections.Counter((r[0], lower(r[1])) for r in plain_copies(data))
    assert collections.Counter(map(tuple, jaccard_join.one_of_each(docs).collect())) == collections.Counter(plain_near(data))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        none = stage(spark, docs.where("doc_id < -1"), folder)
        assert none.count() == 0 and none.columns == docs.columns
