import json

from pyspark.sql import functions as F

from leadlake.operators.filters import drop_captcha_pages
from leadlake.plans.leads import leads_from_pages
from leadlake.schemas import CAPTURED_PAGE, FEED_CARD, SEARCH_JOB
from leadlake.sources.jobs import read_search_jobs, route_job_messages
from leadlake.sources.pages import extract_place_fields, extract_place_links, place_raw, read_captured_pages

PHOTO = "https://lh5.googleusercontent.com/p/" + "x" * 20
PAGE = f"""<!DOCTYPE html><html><body><!-- <h1 class="DUwDvf">no</h1> --><script>'<h1 class="DUwDvf">no</h1>'</script>
<div role="feed"><img src="{PHOTO}feed"></div><h1>outside</h1>
<div role=main class='x'><h1 class="a DUwDvf"> Caf&eacute; <b>Bom</b> </h1>
<div class="F7nice"><span aria-hidden="true">4,6</span><span aria-hidden="true">(1.234)</span></div>
<button aria-label="1.234 avalia&ccedil;&otilde;es">x</button><button class="DkEaL">Cafeteria</button>
<button data-item-id="address"><div class=Io6YTe>Rua A, 1 - Centro, Recife - PE</div></button>
<button data-item-id="phone:tel:81" aria-label="Phone: 81 9"><div></div></button>
<a data-item-id="authority" href="https://cafe.com/?a=1&amp;b=2">s</a>
<a href="https://www.instagram.com/">home</a><a href="https://www.instagram.com/cafe/?hl=pt">ig</a>
<div data-item-id="oh"><span class="Io6YTe">Aberto
Fecha 18h</span></div><p>um<p>dois<br/>
<img src="{PHOTO}=w80-h92"></div>
<div role="main"><a href="https://www.instagram.com/other">ig</a></div></body>"""


def raw_of(spark, *pages):
    df = spark.createDataFrame([(f"u{i}", p) for i, p in enumerate(pages)], "url string, html string")
    return [r.asDict() for r in place_raw(extract_place_fields(df)).orderBy("url").collect()]


def test_place_fields(spark):
    found, empty, broken = raw_of(spark, PAGE, "", "<div><h1 jstcache=3>N</div></b><button aria-label='Telefone: 1'>")
    assert found == {
        "url": "u0", "name": "Café Bom", "address": "Rua A, 1 - Centro, Recife - PE", "phone_raw": "81 9", "site_href": "https://cafe.com/?a=1&b=2",
        "instagram_links": ["https://www.instagram.com/", "https://www.instagram.com/cafe/?hl=pt"], "rating_raw": "4,6",
        "review_labels": ["1.234 avaliações"], "rating_spans": ["4,6", "(1.234)"], "category_raw": "Cafeteria", "hours_raw": "Aberto\nFecha 18h",
        "photos": [f"{PHOTO}=w80-h92"],
    }
    assert empty["name"] == "" and empty["photos"] == [] and empty["hours_raw"] is None
    assert broken["name"] == "N" and broken["phone_raw"] == ""


def test_links_and_blocked_pages(spark):
    html = '<a href="/maps/place/A?x=1&amp;y=2">a</a><a href="/other">o</a><a class="c" href="https://m/maps/place/B">b</a>'
    pages = spark.createDataFrame([("u", html), ("v", "<p>reCAPTCHA</p>"), ("w", None)], "url string, html string")
    assert [tuple(r) for r in extract_place_links(pages).orderBy("position").collect()] == [("u", 0, "/maps/place/A?x=1&y=2"), ("u", 1, "https://m/maps/place/B")]
    assert sorted(r.url for r in drop_captcha_pages(pages).collect()) == ["u", "w"]


def test_page_files(spark, tmp_path):
    df = spark.createDataFrame([("u", "<p>", None)], CAPTURED_PAGE)
    df.write.parquet(str(tmp_path / "p"))
    assert read_captured_pages(spark, str(tmp_path / "p")).collect() == df.collect()


def test_jobs_from_files_and_messages(spark, tmp_path):
    records = [{"job_id": "1", "keyword": "bar", "max_results": 0}, {"job_id": ""}, {"keyword": "x"}, {}, {"job_id": "2", "city": "X", "max_results": "7", "country": "PT"}]
    (tmp_path / "jobs.json").write_text("\n".join(json.dumps(r) for r in records))
    expected = {("1", None, "bar", "", "", "BR", 20), ("2", None, "", "X", "", "PT", 7)}
    assert {tuple(r) for r in read_search_jobs(spark, str(tmp_path)).collect()} == expected
    assert read_search_jobs(spark, str(tmp_path), stream=True).isStreaming
    texts = [json.dumps({"type": "job", "payload": records[4]}), '{"type":"ping"}', '{"type":"job"}', "{oops", "", None, json.dumps({"type": "note", "payload": records[0]})]
    messages = spark.createDataFrame([(t,) for t in texts], "message string")
    assert [r.job_id for r in route_job_messages(messages).collect()] == ["2"]


def test_cap_comes_before_dedup_and_cache_hits_skip_the_address_check(spark):
    def page(name, phone, address="Rua A - Centro, Recife - PE"):
        return (f'<div role="main"><h1>{name}</h1><button data-item-id="address"><p class="Io6YTe">{address}</p></button>'
                f'<button data-item-id="phone:tel:1"><p class="Io6YTe">{phone}</p></button></div>')

    jobs = spark.createDataFrame([("j", "s", "bar", "Recife", "PE", "BR", 3), ("k", "s", "bar", "Recife", "PE", "BR", 9)], SEARCH_JOB)
    visits = [("j", u) for u in ("a", "a2", "b", "c")] + [("k", u) for u in ("d", "a", "d", "b", "x", "f")]
    cards = spark.createDataFrame([(job, 1, i, url, "", "", "", "") for i, (job, url) in enumerate(visits)], FEED_CARD)
    pages = spark.createDataFrame(
        [("a", page("A", 1)), ("a2", page("Á", 2)), ("b", page("B", 3)), ("c", page("C", 4)), ("d", page("D", 5, "Rua - X, Natal - RN")),
         ("x", page("X", 6) + "recaptcha"), ("f", page("", 7))], "url string, html string")
    found = leads_from_pages(jobs, cards, pages)
    assert sorted((r.job_id, r.name) for r in found.collect()) == [("j", "A"), ("j", "B"), ("k", "A"), ("k", "B")]

    from leadlake.functions.search import place_key
    from leadlake.schemas import LEAD_COLUMNS

    cached = found.where("job_id = 'k' and name = 'B'").withColumns({"name": F.lit("Cached"), "address": F.lit("nowhere"), "phone": F.lit("99")})
    cache = cached.select(place_key(F.lit("x")).alias("key"), F.struct(*LEAD_COLUMNS).alias("lead"), F.lit(1.0).alias("cached_at"), F.lit(10).alias("ttl_s"))
    again = leads_from_pages(jobs, cards, pages, cache, now=5.0)
    assert sorted((r.job_id, r.name) for r in again.collect()) == [("j", "A"), ("j", "B"), ("k", "A"), ("k", "B"), ("k", "Cached")]
    expired = leads_from_pages(jobs, cards, pages, cache, now=50.0)
    assert "Cached" not in {r.name for r in expired.collect()}


def test_the_latest_capture_of_an_address_counts(spark):
    from datetime import datetime

    from leadlake.plans.leads import extract_pages

    page = lambda name: f'<html><body><div role="main"><h1 class="DUwDvf">{name}</h1></div></body></html>'
    rows = [("u", page("Old"), datetime(2024, 1, 1)), ("u", page("New"), datetime(2024, 1, 2)), ("u", page("New"), datetime(2024, 1, 2)), ("v", page("Other"), None)]
    pages = spark.createDataFrame(rows, "url string, html string, captured_at timestamp")
    wanted = spark.createDataFrame([("u",), ("v",)], "url string")
    for table in (pages, pages.drop("captured_at")):
        assert sorted(r.url for r in extract_pages(table, wanted).collect()) == ["u", "v"]
    assert {r.url: r.name for r in extract_pages(pages, wanted).collect()}["u"] == "New"
