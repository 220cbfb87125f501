"""Each stage of the corpus pipeline against a brute-force version on its own input, and the guard of the entry file."""

import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F
from test_llm_operators import SMALL, brute_simhash, words

import corpus_pipeline
from barloom.llm import quality
from barloom.llm.common import cut, table


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    bench = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), "t")
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            usable = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
            model = quality.train(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"), usable)
            want = {r.doc_id for r in quality.score(table(spark, SMALL, "documents"), model).where("score >= 0.3").collect()}
        elif name == "exact dedup":
            first = {}
            for i, t in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            want = set(first.values())
        elif name == "SimHash near-dedup":
            want = {c for _, _, c in brute_simhash(kept)}
        elif name == "benchmark decontamination":
            low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
            grams = {tuple(w[k : k + 10]) for w in map(low, bench) for k in range(max(1, len(w) - 9) if w else 0)}
            sizes = {len(g) for g in grams}
            want = {i for i, t in kept if not any(tuple(w[k : k + n]) in grams for w in [low(t)] for n in sizes for k in range(len(w) - n + 1))}
        else:
            times = {r.doc_id: r for r in docs.collect()}
            assert all(r["size"] == len(words(r.text)) and r.taken == r.times * r["size"] and 1 <= r.times <= 3 for r in times.values())
            want = set(times)
            assert docs.columns[: len(columns)] == columns
            by = docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
            assert all(abs(r.taken - r.target) <= max(len(words(t)) for _, t in kept) for r in by)
        assert set(got) == want and set(got) <= {i for i, _ in kept}, name
        if name != "mixing sources":
            assert docs.columns == columns
        kept = list(got.items())
    assert 50 < len(kept) < 200


def test_run_is_the_stages(spark):
    """run() gives what the stages give one after another, whichever way the rows lie; reruns agree."""
    docs = table(spark, SMALL, "documents").repartition(7)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), "t")
    key = lambda r: (r.doc_id, r.text, r.times, r.taken)
    want = sorted(map(key, docs.collect()))
    assert want == sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) and len(want) > 50


def test_stages_on_edge_cases(spark, docs, clashing, empty, benchmark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables: each stage against loops."""
    at = str(tmp_path)
    spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id LONG, quality INT").write.parquet(f"{at}/labels.parquet")
    benchmark.write.parquet(f"{at}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for own in (docs, clashing):
        kept = stages["quality classifier"](spark, own, at)
        assert kept.columns == own.columns and 0 < kept.count() <= len(rows)
        out = stages["exact dedup"](spark, own, at)
        least = {}
        for i, t in rows:
            k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
        got = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in out.collect()]
        assert out.columns == own.columns and sorted(got, key=str) == sorted(((i, k) for k, i in least.items()), key=str)
        out = stages["SimHash near-dedup"](spark, own, at)
        assert out.columns == own.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted(of_components(rows), key=str)
        out = stages["benchmark decontamination"](spark, own, at)
        low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        items = [low(r.text) for r in benchmark.collect()]
        grams = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9) if w else 0)}
        want = [(i, t) for i, t in rows if not any(tuple(w[k : k + len(g)]) == g for w in [low(t)] for g in grams for k in range(len(w) - len(g) + 1))]
        assert out.columns == own.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
        out = stages["mixing sources"](spark, own, at)
        assert out.where("times > 3 OR times < 1").count() == 0 and out.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0, name
    for name in ("labels", "benchmark"):
        table(spark, at, name).where("false").coalesce(1).write.parquet(f"{at}/none/{name}.parquet")
    assert stages["quality classifier"](spark, docs, f"{at}/none").count() == stages["benchmark decontamination"](spark, docs, f"{at}/none").count() == len(rows)


def of_components(rows):
    """The doc_id that stays of each component: rows without an id stay apart from it only if their texts do."""
    held = brute_simhash([(k, t) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, _, c in held:
        groups.setdefault(c, []).append(rows[k][0])
    return [min((i for i in g if i is not None), default=None) for g in groups.values()]


def test_rest_imports_without_this_subpackage(tmp_path):
    import shutil

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'rsi' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
