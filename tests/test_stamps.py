"""Lateral stamps on literal pages."""

from caseloom.operators import stamps

CASE, OTHER = "1000045-12.2024.8.26.0100", "2222222-12.2024.8.26.0100"
FULL = f"Este documento é cópia do original, assinado digitalmente por ANA  MARIA e Tribunal de Justiça do Estado de São Paulo, protocolado em 02/03/2024 às 10:15, sob o número WPRC24700. Para conferir o original, acesse https://example.org/pastadigital, informe o processo {CASE} e código AB12cd."
RELEASED = f"Este documento foi liberado nos autos em 05/03/2024 às 9:05, assinado digitalmente por José Lima. Para conferir o original informe o processo {OTHER} e o código ZZ9."


def rows_of(spark, texts):
    """texts: (doc, page, region, width, text)"""
    return spark.createDataFrame([(d, p, r, 0.0, 0.0, float(w), 10.0, t) for d, p, r, w, t in texts], "doc string, page int, region string, x0 double, y0 double, x1 double, y1 double, text string")


def test_fields_of_a_stamp(spark):
    df = spark.createDataFrame([(0, FULL), (1, RELEASED), (2, "Assinado digitalmente por Só Nome"), (3, ""), (4, "liberado nos autos em as 7:00")], "i int, t string")
    from pyspark.sql import functions as F

    got = {r["i"]: tuple(r["f"]) for r in df.select("i", stamps.fields(F.col("t")).alias("f")).collect()}
    assert got[0] == ("PROTOCOLADO", "02/03/2024", "10:15", "ANA MARIA", "WPRC24700", "AB12cd", "https://example.org/pastadigital", [CASE])
    assert got[1] == ("LIBERADO NOS AUTOS", "05/03/2024", "9:05", "José Lima", None, "ZZ9", None, [OTHER])
    assert got[2] == (None, None, None, "Só Nome", None, None, None, [])
    assert got[3] == (None,) * 7 + ([],) and got[4][:3] == ("LIBERADO NOS AUTOS", None, "7:00")


def test_outer_stamps_and_groups(spark):
    both = FULL + " " + RELEASED
    pages = [("d", 1, "r1", 500, FULL), ("d", 2, "r1", 500, both), ("d", 3, "r1", 500, RELEASED), ("d", 4, "r1", 100, FULL), ("d", 4, "r2", 900, FULL.replace("WPRC24700", "WPRC999")), ("d", 6, "r1", 9, FULL.replace("WPRC24700", "WPRC999")), ("d", 7, "r", 9, "plain text"), ("d", 8, "r", 9, None)]
    found = stamps.stamps(rows_of(spark, pages), CASE)
    counts = {(r["page"], r["stamp"]) for r in found.collect()}
    assert counts == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2), (6, 1)}
    outer = stamps.outer_stamps(found, CASE)
    assert {(r["page"], r["stamp"], r["protocol"]) for r in outer.collect()} == {(1, 1, "WPRC24700"), (2, 1, "WPRC24700"), (4, 2, "WPRC999"), (6, 1, "WPRC999")}
    groups = sorted((r["first_page"], r["last_page"], r["n_pages"]) for r in stamps.filing_groups(outer).collect())
    assert groups == [(1, 2, 2), (4, 4, 1), (6, 6, 1)]
    free = stamps.outer_stamps(stamps.stamps(rows_of(spark, pages)))
    assert {r["page"] for r in free.collect()} == {1, 2, 3, 4, 6}
    by_literal = [r for r in free.collect() if r["page"] == 3]
    assert by_literal[0]["filing"] is not None and by_literal[0]["protocol"] is None
    assert stamps.stamps(rows_of(spark, pages).limit(0)).count() == 0
