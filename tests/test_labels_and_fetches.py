"""Labels as the rules give them, and which files need no download."""

from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import dedup


def test_labels(spark):
    cases = [("FORD MOTOR CO-OP AND SONS", "Ford Motor Co-Op and Sons"), ("o'neil 2nd_unit", "O'Neil 2nd_unit"), ("", ""), ("été and", "éTé and")]
    df = spark.createDataFrame([c[:1] for c in cases], "s string").coalesce(1)
    assert [r[0] for r in df.select(text.title_case("s")).collect()] == [c[1] for c in cases]
    makers = [("Toyota Motor North America, Inc.", "Toyota Motor"), ("Acme (West)  LLC", "Acme"), ("General Corp. of America", "General of"), ("Plain", "Plain")]
    df = spark.createDataFrame([c[:1] for c in makers], "s string").coalesce(1)
    assert [r[0] for r in df.select(text.short_maker("s")).collect()] == [c[1] for c in makers]
    titles = [("In re: Zantac (Ranitidine) Products Liability Litigation", "Zantac (Ranitidine)"), ('IN RE "Widget" Marketing, Sales Practices and Products Liability Litigation', "Widget"), ("Antitrust Litigation", "Antitrust Litigation"), ("Smith v. Jones", "Smith v. Jones")]
    df = spark.createDataFrame([c[:1] for c in titles], "s string").coalesce(1)
    assert [r[0] for r in df.select(text.short_title("s")).collect()] == [c[1] for c in titles]


def test_fetch_decisions(spark):
    def sha1(k):
        return f"{k:040x}"

    def sha256(k):
        return f"{k:064x}"

    objects = [(sha256(k), sha1(k), 100 + k) for k in range(1, 8)] + [(sha256(50), sha1(7), 5), (sha256(60), "bad", 5), (None, None, None)]
    urls = [("https://a.org/1", sha256(1)), ("https://A.org/1#x", sha256(1)), ("https://a.org/2", sha256(2)), ("https://a.org/2", sha256(3)), ("https://a.org/9", sha256(9)), ("http://a.org/4", sha256(4)), (None, sha256(1)), ("https://a.org/5", "bad")]
    queue = [(1, "p", "https://a.org/x", sha1(3).upper(), 7), (2, "p", "https://a.org/1", None, None), (3, "p", "https://a.org/1#page", sha1(4), None), (4, "p", "https://a.org/1", None, 999), (5, "p", "https://a.org/2", None, None), (6, "p", "https://a.org/9", None, None),
             (7, "p", "https://a.org/4", None, None), (8, "q", "https://a.org/1", sha1(1), None), (9, "p", "https://a.org/1", sha1(7), 101), (10, "p", None, "short", -1), (11, None, "https://a.org/1", None, None), (12, "p", "https://a.org/1", sha1(1), 5), (13, "p", "https://user@a.org/1", None, None), (14, "p", "https://a.org/1", sha1(99), None)]
    got = {r.id: (r.action, r.reason, r.sha256) for r in dedup.fetch_decisions(spark.createDataFrame(queue, "id int, provider string, url string, sha1 string, bytes long"), spark.createDataFrame(objects, "sha256 string, sha1 string, bytes long"), spark.createDataFrame(urls, "url string, sha256 string"), ["p"]).collect()}
    assert got == {
        1: ("skip", "same sha1", sha256(3)), 2: ("skip", "same address", sha256(1)), 3: ("skip", "same sha1", sha256(4)), 4: ("download", "size has changed", None), 5: ("download", "several versions of the address", None), 6: ("download", "object not in the index", None),
        7: ("download", "nothing known", None), 8: ("download", "other provider", None), 9: ("download", "sha1 has changed", None), 10: ("download", "nothing known", None), 11: ("download", "other provider", None), 12: ("skip", "same sha1", sha256(1)), 13: ("download", "nothing known", None), 14: ("download", "sha1 has changed", None),
    }
    assert spark.range(1).select(dedup.verified_url(F.lit("HTTPS://X.org")).alias("u")).first().u == "https://x.org/"
