from pyspark.sql import functions as F

from linklake.functions import urls
from linklake.operators import screening

CASES = {
    # address: (canonical form, resource key)
    "https://www.quietcharts.dev/": ("https://www.quietcharts.dev/", "quietcharts.dev"),
    "http://zh.podhub.sk": ("https://zh.podhub.sk/", "podhub.sk"),
    "https://kit.loomworks.com/docs/parts/switch": ("https://kit.loomworks.com/docs/parts/switch", "kit.loomworks.com"),
    "https://wharf.vercel.app/#view=far": ("https://wharf.vercel.app/#view=far", "wharf.vercel.app"),
    "https://a.pages.dev/": ("https://a.pages.dev/", "a.pages.dev"),
    "https://github.com/Tern/shore/blob/main/NOTES.md": ("https://github.com/Tern/shore/blob/main/NOTES.md", "github.com/tern/shore"),
    "https://a.com/x?utm_source=x&id=7&spm=1": ("https://a.com/x?id=7", "a.com"),
    "https://a.com/?ref=weekly": ("https://a.com/", "a.com"),
    "a.com/b/../c/./d?z=1&a=%20x&a=2#/": ("https://a.com/c/d?a=+x&a=2&z=1", "a.com"),
    "https://u:p@A.com:443/中 文/?q": ("https://a.com/%E4%B8%AD%20%E6%96%87?q=", "a.com"),
    "https://a.com:8080/x/)。": ("https://a.com:8080/x", "a.com"),
    "https://www.npmjs.com/package/React/": ("https://www.npmjs.com/package/React", "npmjs.com/package/react"),
    "https://m.en.com": ("https://m.en.com/", "en.com"),
    "not a url": (None, None),
    "ftp://a.com/x": (None, None),
    "https://a.com:99999/": (None, None),
}


def test_canonical_form_and_key(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    got = urls.with_resource_key(urls.canonicalise(df, keep_bad=True))
    assert {r.url: (r.u_url, r.key) for r in got.collect()} == CASES
    # Rows that are no URL are dropped by default.
    assert urls.canonicalise(df).count() == len([v for v in CASES.values() if v[0]])


def test_canonical_form_is_stable(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    once = urls.canonicalise(df).select(F.col("u_url").alias("url"))
    changed = urls.canonicalise(once).filter("url <> u_url")
    assert changed.count() == 0


def test_best_url_prefers_the_landing_page(spark):
    df = spark.createDataFrame([("https://a.com/docs/deep/page",), ("https://a.com/",), ("https://a.com/?x=1",)], "url string")
    got = urls.canonicalise(df).withColumn("rank", urls.url_rank()).agg(F.min_by("u_url", "rank")).first()[0]
    assert got == "https://a.com/"


def test_link_keys(spark):
    df = spark.createDataFrame(
        [("https://x.com/marsh_lab/status/1840027731150012416?s=20",), ("https://twitter.com/i/status/1840027731150012416",),
         ("https://github.com/fern-works/kiln-test.git",), ("https://a.com/?q=1",)], "url string")
    got = [r.key for r in urls.with_link_key(urls.canonicalise(df)).collect()]
    assert got == ["x.com/status/1840027731150012416"] * 2 + ["github.com/fern-works/kiln-test", "a.com/?q=1"]


SCREEN = {
    "https://eu.console.harbour.com/main/start": (True, None),
    "https://secure.granary.com/b_list.htm": (True, None),
    "http://jira.frp.example.com/browse/OAK-7?jql=y": (True, None),
    "https://api.fernlab.cn/console": (True, "https://api.fernlab.cn/"),
    "https://mill.com/login": (True, "https://mill.com/"),
    "https://ledgerly.com/account": (False, None),
    "https://studio.claywheel.ai/workspace/new": (True, "https://studio.claywheel.ai/"),
    "http://10.44.8.12/entry/login.php": (True, None),
    "https://a.com/a/b/c.pdf?token=1": (True, "https://a.com/a/b"),
    "https://a.com/?token=1": (True, None),
    "https://a.com/docs/settings/x": (True, "https://a.com/docs"),
    "https://a.com/x?v=" + "a" * 61: (True, "https://a.com/"),
    "https://a.com/x#access_token=1": (True, "https://a.com/"),
    "https://blocked.org/x": (True, None),
    "https://sub.blocked.org/": (True, None),
}


def test_privacy_screen(spark):
    df = spark.createDataFrame([(u,) for u in SCREEN], "url string")
    block = spark.createDataFrame([("blocked.org",)], "domain string")
    got = {r.url: (r.is_private, r.public_ancestor) for r in screening.screen(df, block).collect()}
    assert got == SCREEN
