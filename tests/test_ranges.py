"""A file read in ranges gives the rows of a reader of the whole file, wherever the ranges end."""

import random

import pytest

from tallyspark.sources import journals
from tallyspark.sources.ranges import Quotes


def rows_of(df):
    return sorted((r["journal_id"].rsplit("/", 1)[1], r["row_ord"], tuple(sorted(r["cells"].items())), r["fault"]) for r in df.collect())


def texts():
    r = random.Random(3)
    cells = ["plain", "", " x ", '"quoted"', '"with ""two"" quotes"', '"line\nbreak"', '"many\n\n\nlines, and\r\nmore"', '5" disk', '"closed"then', "é", "a\rb", '""', "semi;colon", '";"', "\t"]
    line = lambda n: ",".join(r.choice(cells) for _ in range(n))
    body = "Symbol,Notes,Profit\n" + "".join(f"{line(r.choice([1, 2, 3, 3, 3, 4]))}\n" for _ in range(400))
    long = "Symbol,Notes,Profit\n" + "".join(f'TIN,"{"word and line" * 9}\n{"more" * r.randrange(300)}",{i}\n' for i in range(60)) + "LAST,no break at the end,1"
    return {
        "body.csv": body.encode(), "windows.csv": body.replace("\n", "\r\n").encode("cp1252"), "bom.csv": b"\xef\xbb\xbf" + body.encode(), "long.csv": long.encode(),
        "latin.csv": body.encode("latin-1") + b"\x81,\x8d,1\n", "semi.csv": body.replace(";", "").replace(",", ";").encode(), "cut.csv": body.encode() + b'TIN,"never closed,1\n' + body.encode(),
        "breaks.csv": ('"Sym\nbol",Notes,Profit\n' + "a,b,1\n" * 300).encode(), "blank.csv": b"\n" * 30 + body.encode(),
    }


@pytest.mark.parametrize("split", [211, 1900])
def test_ranges_as_whole(spark, tmp_path, monkeypatch, split):
    place = tmp_path / "in"
    place.mkdir()
    for name, content in texts().items():
        (place / name).write_bytes(content)
    whole = rows_of(journals.read_cells(spark, str(place)))
    monkeypatch.setattr(journals, "LARGE_FILE", 100)
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        cells = journals.read_cells(spark, str(place))
        ranged = rows_of(cells)
        assert len({r[0] for r in ranged}) == len(texts())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Of a file that ends inside quotes no row counts, whichever way it is read.
    sound = lambda rows: [x for x in rows if x[0] != "cut.csv" or x[3]]
    assert sound(ranged) == sound(whole)


def test_quotes():
    comma, semi = Quotes(","), Quotes(";")
    for line, inside, want in [
        (b"a,b", False, False), (b'a,"b', False, True), (b'b"', True, False), (b'b"",c', True, True), (b'b",c,"d', True, True), (b'5" a,b', False, False),
        (b'"a""b"', False, False), (b'"a"x"', False, False), (b'a;"b', False, False), (b'x\r"y', False, True), (b"", True, True), (b'"', True, False),
    ]:
        assert comma.after(line, inside) is want, line
    assert semi.after(b'a;"b', False) and not semi.after(b'a,"b', False)
