from pyspark.sql import functions as F

from corpusloom.sources import files


def test_manifest(spark, tmp_path):
    for name, data in {"a.txt": b"plain words", "b.pdf": b"not a pdf", "c.pdf": b"%PDF-1.7 x", "noext": b"x", "e.exe": b"x", "f.html": b"<html><body>Hi <b>you</b></body></html>", "g.docx": b"PK\x03\x04x"}.items():
        (tmp_path / name).write_bytes(data)
    f = files.manifest(spark, str(tmp_path)).select("path", "length", "content")
    f = f.unionByName(spark.createDataFrame([("x/d.txt", 0, bytearray())], f.schema))  # the reader leaves empty files out
    got = {r.path.rsplit("/", 1)[1]: (r.reject_code, r.reject_reason) for r in files.validate(f).collect()}
    assert got["a.txt"] == got["c.pdf"] == got["f.html"] == got["g.docx"] == (None, None)
    assert got["b.pdf"][0] == 415 and got["e.exe"] == (415, "unsupported type") and got["d.txt"] == (400, "empty") and got["noext"] == (400, "no extension")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.scan(f).collect()}["f.html"] == "Hi you"


def test_markdown(spark):
    d = spark.createDataFrame([("# Head\n**bold** [link](http://x) ![i](y)\n- item\n| a | b |\n|---|---|\n| 1 | 2 |",)], "m string")
    t = d.select(files.markdown_text(F.col("m"))).first()[0]
    assert "#" not in t and "**" not in t and "http" not in t and "|" not in t and "link" in t and "a b" in t and "1 2" in t
