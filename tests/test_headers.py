"""Where headers begin is looked at sign by sign only where one can begin."""

from pyspark.sql import functions as F

from regulith.rules import fr_articles as fr


def test_headers_begin_where_they_did(spark):
    plain = rf"(?iuUdm)(?<=^[ \t]{{0,40}}\[?[ \t]{{0,4}})(?<!\w)(?={fr._NAMED}|{fr._NUMBERED})|(?<!\w)(?={fr._NAMED}\s*[-:–—])"
    texts = ["Article 1 - a\nart. 2-3 b\n  [ ARTICLE premier : c", "voir article 5 - d, l'art. 6 : e\n12. f\n\t3 bis - g", "x1 - h article\nÀ 4 - i\n٣ - j\nart k", "", "article unique"]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select(F.split("t", plain).alias("a"), F.split("t", fr.BEFORE_HEADER).alias("b"))
    rows = x.collect()
    assert all(r.a == r.b for r in rows) and len(rows[0].a) >= 3 and fr.BEFORE_HEADER.startswith(r"(?iuUdm)(?=[a\d])")
