from leadlake.sources.cards import extract_feed_cards

LIST = """<html><body><style>.x {}</style><div role="feed">
<div jsaction="a:b"><div><a class="hfpxzc" href="https://g.com/maps/place/A?x=1&amp;y=2"></a></div><script>var MW4etd = 1;</script>
 <div class="NrDZNb"><div class="qBF1Pd fontHeadlineSmall"> Caf&eacute; <b>Um</b> </div><div class="qBF1Pd">second</div></div>
 <span class="MW4etd"> 4,6 </span><span class="UY7F9">(1.234)</span>
 <div class="u"><div class="W4Efsd"><span>first lines</span></div><div class="W4Efsd"><div class="W4Efsd"><span>x</span><span><span>· Cafeteria</span><span>· Rua</span></span></div></div></div></div>
<div><a href="/maps/place/B">no clicks</a><span class="MW4etd">3,0</span></div>
<a href="/elsewhere">no place</a>
<div jsinstance="0"><section jsaction><a href="/maps/place/C"></a><div class="fontHeadlineSmall">C</div><div class="W4Efsd"><span><span> · Bar</span></span></div><p>end</p></section></div>
</div></body></html>"""
PLACE = '<h1 class="DUwDvf"> Only one </h1><a href="/maps/place/other">x</a>'


def cards_of(spark, *pages):
    df = spark.createDataFrame([(i, url, html, "own") for i, (url, html) in enumerate(pages)], "page int, url string, html string, name string")
    rows = extract_feed_cards(df, keep=["page"]).orderBy("page", "position").collect()
    return [tuple(r) for r in rows]


def test_cards_of_a_list(spark):
    assert cards_of(spark, ("https://g.com/maps/search/x", LIST)) == [
        (0, 0, "https://g.com/maps/place/A?x=1&y=2", "Café Um", "4,6", "1234", "Cafeteria"),
        (0, 1, "/maps/place/B", "", "3,0", "", ""),
        (0, 2, "/maps/place/C", "C", "", "", "Bar"),
    ]


def test_a_place_page_is_one_card_and_broken_pages_have_none(spark):
    found = cards_of(spark, ("https://g.com/maps/place/P", PLACE), ("https://g.com/maps/search/x", PLACE), ("u", None), ("u", ""), (None, "<a href='/maps/place/D'"),
                     (None, "</div><a href='/maps/place/E'>"))
    assert found == [
        (0, 0, "https://g.com/maps/place/P", "Only one", "", "", ""),
        (1, 0, "/maps/place/other", "", "", "", ""),
        (5, 0, "/maps/place/E", "", "", "", ""),
    ]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "url string, html string")
    assert extract_feed_cards(empty).columns == ["url", "position", "link", "name", "rating", "reviews", "category"]
    assert extract_feed_cards(empty).count() == 0
