"""The pipeline and the entry, with and without this subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


def _classes(rows):
    """(doc_id, least doc_id of its class, links) by comparing all pairs of five-word shingle sets."""
    from test_operators import _brute_links

    return _brute_links(rows)


def test_stages_keep_columns_and_clean_rows(spark):
    import corpus_pipeline as p
    from tessera.llm import decontamination, near_duplicates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumns({"score": F.lit(1.5), "class_id": F.lit("x"), "doc": F.struct("doc_id")})
    assert [n for n, _ in p.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "packing"]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.schema.simpleString() == extra.schema.simpleString(), name
    labels = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()))
    kept = {r[0] for r in p.keep_known_language(spark, docs, SF).select("doc_id").collect()}
    assert len(kept) == docs.count()
    kept = {r[0] for r in p.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    assert sum(i in kept for i, t in labels.items() if t == 0) > 0.97 * sum(t == 0 for t in labels.values())
    found = near_duplicates.near_duplicates(docs).collect()
    assert {r[0] for r in p.keep_one_of_each_group(spark, docs, SF).select("doc_id").collect()} == {r["doc_id"] for r in found if r["doc_id"] == r["class_id"]}
    dirty = {r["doc_id"] for r in decontamination.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r["item_ids"]}
    assert dirty and {r[0] for r in p.drop_contaminated(spark, docs, SF).select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - dirty


def test_repeated_rows_of_a_kept_id_become_one(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    out = p.keep_one_of_each_group(spark, docs.unionAll(docs), SF)
    assert out.count() == out.select("doc_id").distinct().count() == p.keep_one_of_each_group(spark, docs, SF).count()


def test_each_class_keeps_one_row_and_other_texts_of_an_id_stay(spark):
    import corpus_pipeline as p

    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    near = [x + " end" for x in texts]
    rows = [(1, texts[0]), (2, near[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[4]), (None, near[4]), (None, None), (None, None), (4, ""), (4, ""), (4, None)]
    out = p.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    got = [tuple(r) for r in out]
    assert sum(r in got for r in ((None, texts[4]), (None, near[4]))) == 1
    want = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (None, None), (None, None), (4, ""), (4, None)]
    assert sorted(map(str, want)) == sorted(str(r) for r in got if r not in ((None, texts[4]), (None, near[4])))


def test_run_equals_a_plain_version_of_its_stages(spark, tmp_path):
    """Every stage over again on lists of rows, without Spark, with the models that the stages learn from the same rows."""
    import corpus_pipeline as p
    from tessera.llm import decontamination, language_id, packing, queries, toxicity
    from tessera.llm.common import tokenizer_path
    from tokenizers import Tokenizer

    small = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    host = base.where("n_chars > 400").orderBy("doc_id").first()["text"]
    more = [(900_000, host[:200] + " " + items[0]["text"] + " " + host[200:400], "en", "web"), (900_001, host + " end", "en", "web"), (900_002, "12 34 !!", "en", "web"), (900_003, None, None, None), (900_004, "", "en", "web")]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    base.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows, path = sorted((r["doc_id"], r["text"]) for r in docs.collect()), tokenizer_path(queries.PIECES)
    languages, prob = language_id.fit_on(docs, F.lit(True), path)
    scored = language_id.Scorer(path, prob.astype("f4").astype(float)).score([t for _, t in rows])
    rows = [r for r, x in zip(rows, scored, strict=True) if x is not None and 1 / sum(2.718281828459045 ** (x - x.max())) >= p.LEAST_LANGUAGE_SCORE]
    assert languages and not {i for i, _ in rows} & {900_002, 900_003, 900_004}
    kept = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    model = toxicity.fit_on(kept, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True))
    rows = [r for r, x in zip(rows, model.scores([t for _, t in rows]), strict=True) if x < p.TOXIC_SCORE]
    rows = [r for r, (i, top, _) in zip(rows, _classes(rows), strict=True) if i == top]
    found = decontamination.Items([(r["item_id"], r["text"]) for r in items], 0.1)
    rows = [r for r in rows if not found.search(r[1])]
    assert not {i for i, _ in rows} & {900_000, 900_001}
    tokenizer = Tokenizer.from_file(tokenizer_path(queries.WORD_BPE))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == want and all(r["doc_tokens"] == want[r["doc_id"]] for r in got) and packing.SCHEMA.count("long") == len(got[0])


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "a calm and quiet day outside " * 3000
    docs = [(1, None, None, None, None), (None, "", "en", "web", 0), (2, long, "en", "web", len(long)), (2, long, "en", "web", len(long)), (3, "²½", "en", None, 2), (None, None, None, None, None)]
    df = spark.createDataFrame(docs, schema).withColumns({"__text": F.lit("x"), "a.b": F.lit(1), "m": F.create_map(F.lit(1), F.lit(2)), "row": F.lit(3)})
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    sizes = {}
    for name, stage in p.STAGES:
        for table in (df, df.limit(0)):
            out = stage(spark, table, str(tmp_path))
            sizes[name] = max(sizes.get(name, 0), out.count())
            assert name == "packing" or out.schema.simpleString() == df.schema.simpleString()
    assert sizes["toxicity"] == sizes["decontamination"] == 6 and sizes["near_duplicates"] == 5 and sizes["language_id"] == 2


def test_the_rest_works_without_this_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tessera"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'transition_metrics' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
