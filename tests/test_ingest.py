import pytest

from sparkdex.sources.ingest import cast_cells, infer_types, read_csv


def types(spark, path, header=True):
    return {n: str(t) for n, t in infer_types(read_csv(spark, path, header))}


def test_inference_rules(spark, write):
    p = write("a.csv", "i,f,d,e,big,x,z,sign,exp\n1,1.5,2024-01-01,,99999999999,ñu,007,+5,1e3\n-2,3,2024-02-01,5,1,b,1,1,2\n")
    assert types(spark, p) == {"i": "INT", "f": "FLOAT", "d": "VARCHAR[10]", "e": "VARCHAR[1]", "big": "LONG", "x": "VARCHAR[3]", "z": "INT", "sign": "VARCHAR[2]", "exp": "VARCHAR[3]"}


def test_bom_blank_lines_short_rows_quotes_and_no_header(spark, write):
    p = write("b.csv", '﻿a,b\n1,"x, ""y"""\n\n2,"two\nlines"\n3\n')
    d = read_csv(spark, p)
    assert d.columns == ["a", "b"]
    assert [tuple(r) for r in d.collect()] == [("1", 'x, "y"'), ("2", "two\nlines"), ("3", None)]
    p = write("c.csv", "1,x\n2,y\n")
    assert types(spark, p, False) == {"col0": "INT", "col1": "VARCHAR[1]"}


def test_long_text_and_late_empty_numbers(spark, write):
    p = write("d.csv", "t,n\n" + "ñ" * 200 + ",1\nb,2\nc,\n")
    cells = read_csv(spark, p)
    kinds = infer_types(cells, sample_rows=2)
    assert [str(t) for _, t in kinds] == ["VARCHAR[255]", "INT"]
    got = [tuple(r) for r in cast_cells(cells, kinds).collect()]
    assert got[0][0] == "ñ" * 127 + "�" and got[2] == ("c", 0)


def test_append_uses_the_table_types(engine, write):
    engine.sql("CREATE TABLE t (a INT, b VARCHAR[2])")
    assert engine.load_csv("t", write("e.csv", "a,b\n1,xyz\n")) == 1
    assert engine.sql("SELECT * FROM t")[0].rows() == [[1, "xy"]]
    with pytest.raises(ValueError):
        engine.load_csv("t", write("f.csv", "a\n1\n"))
    engine.sql(f"CREATE TABLE u FROM FILE '{write('g.csv', 'k,v' + chr(10) + '1,x' + chr(10))}' USING INDEX ISAM(k)")
    r = engine.sql("SELECT v FROM u WHERE k = 1")[0]
    assert r.rows() == [["x"]] and r.used_index == {"column": "k", "type": "ISAM"}
