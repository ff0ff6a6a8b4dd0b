"""Kernels and readers on small inputs."""

import zlib

from pdfmaker import E, T, make
from pyspark.sql import functions as F

from lectern.catalogue import CRITERIA, RULES
from lectern.operators import kernels as k
from lectern.rules.base import builders
from lectern.rules.tables import row_widths
from lectern.sources.pdf.crypt import aes_open, aes_shut, rc4
from lectern.sources.pdf.objects import File, Lexer, Name, Ref, _ascii85, _lzw, _predict, text
from lectern.sources.pdf.reader import read_file, resolve


def test_every_active_rule_is_built():
    assert {r.id for r in RULES if r.status == "active"} == set(builders())
    assert len(RULES) == 91 and len(CRITERIA) == 86


def test_row_widths():
    assert row_widths([[(1, 2), (1, 1)], [(1, 1)]]) == [2, 2]
    # A span over the last column runs out a row early, unless strict.
    assert row_widths([[(1, 1), (1, 2)], [(1, 1)]]) == [2, 1]
    assert row_widths([[(1, 1), (1, 2)], [(1, 1)]], strict=True) == [2, 2]
    assert row_widths([[(3, 1)], [], [(1, 1), (2, 1)]]) == [3, 0, 3]


def test_role_map():
    assert resolve("Head", {"Head": "Title", "Title": "H1"}) == ("H1", False)
    assert resolve("Up", {"Up": "Down", "Down": "Up"}) == ("Up", True)
    assert resolve("Odd", {}) == ("Odd", False)


def test_lexer():
    lex = Lexer(b"<</A#20B (a\\(b\\)\\101) /C [1 2 0 R -.5 <48 6>]>> % end\n true")
    assert lex.next() == {"A B": b"a(b)A", "C": [1, Ref(2, 0), -0.5, b"H`"]}
    assert lex.next() is True
    assert text(b"\xfe\xff\x00A") == "A" and text(Name("N")) == "N" and text(3) is None


def test_filters():
    assert _ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert _predict(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_ciphers():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key = bytes.fromhex("000102030405060708090a0b0c0d0e0f")
    assert aes_shut(key, bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    data = bytes(range(48))
    assert aes_open(key + key, aes_shut(key + key, data, bytes(16)), bytes(16), pad=False) == data


def test_damaged_table_is_scanned():
    data = make([E("P", [T("hello there")])])
    broken = data[: data.rindex(b"startxref")] + b"startxref\n5\n%%EOF"
    rows = read_file(1, "x.pdf", broken)
    assert [r[4] for r in rows["runs"]] == ["hello there"]


def test_object_streams():
    inner = b"1 0 2 30 <</Type/Catalog/Pages 2 0 R>>   <</Type/Pages/Kids[]/Count 0>>"
    first = inner.index(b"<<")
    inner = inner[:first].replace(b"30", b"%02d" % (inner.rindex(b"<<") - first)) + inner[first:]
    packed = zlib.compress(inner)
    out = b"%PDF-1.5\n"
    at3 = len(out)
    out += b"3 0 obj <</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>> stream\n" % (first, len(packed)) + packed + b"\nendstream endobj\n"
    table = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in ((0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at3, 0), (1, len(out), 0)))
    at4 = len(out)
    out += b"4 0 obj <</Type/XRef/Size 5/W[1 2 1]/Root 1 0 R/Length %d>> stream\n" % len(table) + table + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at4
    assert File(out).root["Type"] == "Catalog"


def test_encrypted_file():
    import hashlib

    from lectern.sources.pdf.crypt import _PAD

    fid, owner, perms = b"0" * 16, bytes(32), -4
    key = hashlib.md5(_PAD + owner + (perms & 0xFFFFFFFF).to_bytes(4, "little") + fid).digest()[:5]
    data = make([E("P", [T("secret")])], encrypt={"Filter": Name("Standard"), "V": 1, "R": 2, "O": owner, "U": rc4(key, _PAD), "P": perms - 512})
    # The permissions don't fit the key, so no password opens it.
    assert "password" in read_file(1, "x.pdf", data)["docs"][0][2]


def test_islands_and_jumps(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 4, 3, 5])], "g int, i int, v int")
    assert [r["i"] for r in k.jumps(df, ["g"], [F.col("i")], "v").orderBy("i").collect()] == [2, 4]
    lag = df.withColumn("d", F.expr("v - lag(v) over (partition by g order by i)"))
    assert [r["n"] for r in k.islands(lag, ["g"], [F.col("i")], F.col("d") > 1, "n").orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_multiset_loss(spark):
    a = spark.createDataFrame([(1, w) for w in "aabc"], "g int, w string")
    b = spark.createDataFrame([(1, w) for w in "abbb"], "g int, w string")
    assert k.multiset_loss(a, b, ["g"], "w").first().asDict() == {"g": 1, "total": 4, "lost": 2}


def test_watched_folder(spark, tmp_path):
    from lectern.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(make([E("P", [T("hello")])], lang=None))
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), only=["DOC-013", "DOC-003"], once=True)
    q.awaitTermination(120)
    assert [r["rule"] for r in spark.read.parquet(str(tmp_path / "out" / "findings")).collect()] == ["DOC-013"]
    assert spark.read.parquet(str(tmp_path / "out" / "results")).first()["verdict"] == "fail"


def test_store_round_trip(spark, tmp_path):
    from lectern.api import check

    (tmp_path / "a.pdf").write_bytes(make([E("P", [T("hello")])], lang=None))
    check(spark, [str(tmp_path / "a.pdf")], only=["DOC-013"], store=str(tmp_path / "s"))
    from lectern.plans.facts import Facts

    again = check(spark, facts=Facts.load(spark, str(tmp_path / "s")), only=["DOC-013"])
    assert again.findings.count() == 1
