"""The entry module: names, SQL against DuckDB, and life without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    return f"[{','.join(map(shown, v))}]" if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", ["adc_topk_l2", "hamming_topk", "recall_stats", "exact_medoid", "zorder_sparse", "dbscan_core_points", "descriptor_edges", "descriptor_gradients", "descriptor_keypoints", "model_search_2iter", "kmedoids_one_step", "dbscan_codebook", "sparse_adc_topk", "sparse_kmedoids_step", "sparse_means_step", "kmeans_parallel_candidates", "dense_text_round_trip", "sparse_text_round_trip", "int_vecs_round_trip", "mixed_folder", "first_rows_of_files", "query_files", "numbered_files", "ground_truth_round_trip", "ground_truth_files", "saved_model_search", "recall_2iter", "assign_ties_high", "empty_cluster_rules", "snapped_2iter", "kmeans_midrange_2iter", "exact_topk_user"])
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_llm(tmp_path):
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'adc_topk_l2' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
