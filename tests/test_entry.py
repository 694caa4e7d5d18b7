import subprocess
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "duplicate_rate" in df.columns


def test_names_agree():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert s.keys() <= q.keys() and len(q) > 100


def test_nothing_else_needs_the_training_data_operators(tmp_path):
    """Without that subpackage the entry module imports and gives the other queries."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_without_the_tokenizer_files():
    """What the subpackage needs may be absent as well; the entry says so and goes on."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert len(e.queries()) > 200 and not any(k.startswith('op') for k in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], check=True, timeout=60, capture_output=True, text=True)
    assert "without the training-data queries" in done.stderr
