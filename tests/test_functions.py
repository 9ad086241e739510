from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import numbers, text
from tallyweave.functions.arithmetic import arithmetic, evaluated
from tallyweave.sources import files


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_decimals(rows):
    df = rows("t string", ("1.091,50",), ("1.234",), ("5,75",), ("€ -1,5",), ("",), ("abc",), (None,), ("1.5",), ("1e5",))
    assert values(df, numbers.italian_decimal(F.col("t"))) == [Decimal("1091.5"), Decimal(1234), Decimal("5.75"), Decimal("-1.5"), None, None, None, Decimal("1.5"), None]
    assert values(df, numbers.screen_decimal(F.col("t")))[1] == Decimal("1.234")
    df = rows("t string", ("1,234.50",), ("1,234",), ("-5,75",), ("x",))
    assert values(df, numbers.voter_decimal(F.col("t"))) == [Decimal("1234.5"), Decimal(1234), Decimal("5.75"), None]
    with pytest.raises(Exception, match="not a decimal number"):
        df.select(numbers.voter_decimal(F.col("t"), strict=True)).collect()


def test_dates(rows):
    df = rows("t string", ("2016-02-29",), ("2017-02-28",))
    assert [str(x)[:10] for x in values(df, numbers.add_years(F.to_timestamp("t"), 1))] == ["2017-02-28", "2018-02-28"]
    assert [str(x)[:10] for x in values(df, numbers.add_years(F.to_timestamp("t"), 8))] == ["2024-02-29", "2025-02-28"]
    df = rows("t string", ("03-02-2024",), ("03/02/2024",), ("2024-02-03",), ("nope",))
    assert [x and str(x)[:10] for x in values(df, numbers.statement_date(F.col("t")))] == ["2024-02-03"] * 3 + [None]


@pytest.mark.parametrize(("expression", "value"), [("3500 * 0.26", "910"), ("12500 * 0.41 - 1270", "3855"), ("0.1 + 0.2", "0.3"), ("-(2 ** 3) / 4", "-2")])
def test_arithmetic(expression, value):
    assert evaluated(expression) == Decimal(value)


@pytest.mark.parametrize("expression", ["__import__('os')", "1 +", "2 ** 5000", "1 / 0", "a", "True", ""])
def test_no_arithmetic(expression):
    with pytest.raises(ValueError):
        evaluated(expression)


def test_arithmetic_column(rows):
    assert values(rows("t string", ("1 + 1",), ("x",), (None,)), arithmetic("t"))[0] == "2"


def test_pages(rows):
    df = rows("t string", ("a\fb",), ("a\n---\nb",), ("{0}----------\na\n\n{1}----------\nb",), ("a",), ("a\n<!-- pagebreak -->\nb",))
    assert values(df, text.ocr_pages(F.col("t"))) == [["a", "b"], ["a", "b"], ["a", "b"], ["a"], ["a", "b"]]


def test_text(rows):
    df = rows("t string", ("Intesa S.p.A. Ltd",))
    assert values(df, text.company_key(F.col("t"))) == ["INTESA"]
    df = rows("t string", ("<think>x</think>```json\n[{\"a\": 1}]\n```",))
    assert values(df, text.json_array(F.col("t"))) == ['[{"a": 1}]']
    df = rows("t string", ("Form 11",), ("form_cg1",), (None,))
    assert values(df, text.form_type(F.col("t"))) == ["form11", "cg1", "undetermined"]
    with pytest.raises(Exception, match="no such form type"):
        rows("t string", ("form 99",)).select(text.form_type(F.col("t"))).collect()
    assert values(rows("t string", ("MARIO ROSSI paid AB1 x",)), text.calmed(F.col("t"))) == ["Mario Rossi paid Ab1 x"]
    assert values(rows("t string", ("# A\nfoo # B bar",)), text.ocr_markdown(F.col("t"))) == ["# A\nfoo\n\n# B bar"]
    assert values(rows("t string", ("<h2>T</h2> \"block_type\": \"x\"",)), text.ocr_markdown(F.col("t"))) == ["## T"]


def test_table(rows):
    df = rows("t array<array<string>>", ([["a", "b|c"], ["long cell"]],), ([],))
    assert values(df, files.table_markdown(F.col("t"))) == ["| a         | b\\|c |\n| --------- | ---- |\n| long cell |      |", ""]


def test_calmed_words_keep_their_length_and_equal_the_sql(spark, tmp_path):
    import duckdb

    from tallyweave.plans import registry

    texts = ["ßAB und ßA", "ΟΔΟΣ XΣ İXİ AİΣ", "ŉAB ﬁX ǰAB ᾀAB ǆAB ıAB ẞAB", "ÄÖ ÉA Éa A", "", None, "A\n AB\n "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.calm for r in registry.queries()["calmed_words"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert found == dict(con.execute(registry.oracle_sql()["calmed_words"]).fetchall())
    assert [len(t) for t in texts if t] == [len(found[k]) for k, t in enumerate(texts) if t]
