import os
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry
from topicloom.functions.wordlists import base_stopwords

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def own(names):
    """The queries of this library's own operators; other modules may add theirs."""
    return {n for n in names if not n.startswith("op") and n != "pipeline"}


def test_stop_words_equal_sparks_list(spark):
    assert list(base_stopwords()) == list(StopWordsRemover.loadDefaultStopWords("german"))


def test_registry_needs_neither_session_nor_spark_files():
    code = (
        "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
        "import __spark_entry__ as e; assert len(e.queries()) > 90 and len(e.oracle_sql()) > 80\n"
        "from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 80


def test_queries_without_oracle_are_the_trained_or_sampled_ones():
    assert own(set(entry.queries()) - set(entry.oracle_sql())) == {
        "sample_texts", "hashed_embeddings", "reduced_dims", "density_clusters", "cluster_run_report", "topic_map",
        "document_map", "knn_graph", "lda_topic_words", "lda_doc_topics", "k_sweep", "lda_training_info",
        "topic_hierarchy_average", "topic_map_js",
    }
