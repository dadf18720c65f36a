import json
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from halyard.model import EngineConfig, Metric
from halyard.plans import engine_queries as engine
from halyard.plans import queries as vector
from halyard.plans.collection import Engine
from halyard.sources.store import CollectionStore

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["vec_id", "score"] and out.first()["vec_id"] == 0


@pytest.mark.parametrize("name", ["topk_cosine", "topk_filtered", "topk_filtered_cap", "cosine_zero_vector", "ordinal_ids", "compact_then_reload", "knn_join", *engine.ORACLE_SQL])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute((vector.ORACLE_SQL | engine.ORACLE_SQL)[name])
    columns = [c[0] for c in cur.description]
    out = (vector.QUERIES | engine.QUERIES)[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(map(tuple, out.select(columns).collect()), key=str) == sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("name", ["settings", "get_by_id", "service_drain", "vector_files"])
def test_engine_on_a_cluster_with_a_mounted_folder(spark, name, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", str(tmp_path))  # no scheme
    monkeypatch.setattr(spark.sparkContext, "_conf", conf)
    assert vector._work_dir(spark) == f"file://{tmp_path}"
    test_queries_against_sql(spark, name)
    with pytest.raises(RuntimeError, match="executors share"):  # a folder of no such contract
        Engine(spark, EngineConfig(data_dir=str(tmp_path))).create("c", 2, Metric.COSINE)


@pytest.mark.parametrize("name", ["ordinal_ids", "external_ids", "compact_then_reload", "append_during_compaction"])
def test_rows_are_inserted_by_several_tasks(spark, name, monkeypatch):
    files, real = [], CollectionStore._entry
    monkeypatch.setattr(CollectionStore, "_counts", lambda self, id_, number, data: files.append(json.loads(self.fs.read(real(self, self.manifest(id_), number)))["files"]) or True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_queries_against_sql(spark, name)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(f) > 1 for f in files) and files


def test_works_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "halyard", tmp_path / "halyard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'topk_cosine' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.queries()) - set(e.oracle_sql()) == {'hnsw_recall_measured'}"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_every_query_has_sql_or_is_tested():
    assert set(vector.ORACLE_SQL) == set(vector.QUERIES) and not set(vector.QUERIES) & set(engine.QUERIES)
    assert set(engine.QUERIES) - set(engine.ORACLE_SQL) == {"hnsw_recall_measured"}


def test_measured_recall(spark):
    rows = engine.QUERIES["hnsw_recall_measured"](spark, SF).collect()
    assert [r["ef_search"] for r in rows] == [10, 50, 100, 200] and all(0.9 <= r["recall"] <= 1 for r in rows[2:])
