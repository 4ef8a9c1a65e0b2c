import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from lodeweave.llm import packing, quality
from tests.conftest import DATA
from tests.llm import test_decontam, test_line_dedup, test_near_text

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and returns."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        out.append((docs, spark.read.parquet(str(folder / name))))
        docs = out[-1][1]
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_stage(spark, stages):
    before, after = stages[0]
    stats = quality.described(before.select("doc_id", "text"))
    model = quality.learn(stats, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    kept = {r.doc_id for r in quality.scored(stats, model).where("score >= 0.3").collect()}
    assert texts(after) == {d: t for d, t in texts(before).items() if d in kept}
    assert 0.6 < len(kept) / before.count() < 1


def test_line_stage(stages):
    before, after = (texts(f) for f in stages[1])
    want = {w[0]: w[3:] for w in test_line_dedup.plain(list(before.items()))}
    got = {r.doc_id: (r.n_bytes, r.sha) for r in stages[1][1].select("doc_id", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("sha")).collect()}
    assert got == want and before.keys() == after.keys()
    assert stages[1][1].where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_near_duplicate_stage(stages):
    before, after = (texts(f) for f in stages[2])
    assert sorted(after) == test_near_text.plain_kept(list(before.items())) and all(after[i] == before[i] for i in after)


def test_decontamination_stage(spark, stages):
    before, after = (texts(f) for f in stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {w[0] for w in test_decontam.plain(list(before.items()), items) if not w[5]}
    assert after == {d: before[d] for d in clean}


def test_packing_stage(stages):
    before, after = stages[4]
    want = {d: len(t.split()) + 1 for d, t in texts(before).items()}
    rows = after.collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got.keys() == want.keys()
    assert all(r.capacity in packing.LENGTHS for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_and_no_rows(spark, odd_docs, no_docs, stage):
    odd = odd_docs  # whose further columns have the names of helpers
    out = p.STAGES[stage][1](spark, odd, SF)
    assert out.count() > 0 and (stage == 4 or out.dtypes == odd.dtypes)
    if stage < 4:
        given = {r.doc_id: r.asDict() for r in odd.collect()}
        assert all(r[c] == given[r.doc_id][c] for r in out.collect() if r.doc_id is not None for c in odd.columns if c not in ("text", "n_chars"))
    assert p.STAGES[stage][1](spark, no_docs, SF).count() == 0
