"""Readers of pages judge a tag once, however many pages are written with it."""

from leadlake.sources import cards, pages

PLACE = ('<div role="main"><h1 class="DUwDvf x">Bar {n}</h1><div class="F7nice"><span aria-hidden="true">4,{n}</span></div>'
         '<div data-item-id="oh"><span class="Io6YTe">Aberto {n}h<br></span></div><p>a<p>b</div><a href="http://www.instagram.com/x">late</a>')
CARD = '<div jsaction="m"><a href="https://g/maps/place/x"></a><div class="qBF1Pd">Bar {n}</div><span class="MW4etd">4,{n}</span></div>'


def judgements(monkeypatch, read, layout):
    calls = []
    plain = pages._Tag.fits
    monkeypatch.setattr(pages._Tag, "fits", lambda tag, wanted: calls.append(wanted) or plain(tag, wanted))
    values = [read(layout.format(n=n)) for n in range(1)]
    once = len(calls)
    values += [read(layout.format(n=n)) for n in range(1, 50)]
    return values, once, len(calls)


def test_place_pages_of_one_layout_are_judged_once(monkeypatch):
    tags = pages._PlaceTags(pages.PLACE_SELECTORS)
    values, once, all_calls = judgements(monkeypatch, lambda html: pages._read_page(html, tags), PLACE)
    fields = pages.PLACE_TEXTS.fieldNames()
    assert [v[fields.index("name")] for v in values] == [[f"Bar {n}"] * 2 for n in range(50)]
    assert [v[fields.index("rating_spans")] for v in values] == [[f"4,{n}"] for n in range(50)]
    assert [v[fields.index("hours")] for v in values] == [f"Aberto {n}h" for n in range(50)]
    assert all(v[fields.index("instagram")] == [] for v in values)
    assert 0 < once == all_calls


def test_result_pages_of_one_layout_are_judged_once(monkeypatch):
    tags = cards._CardTags()
    values, once, all_calls = judgements(monkeypatch, lambda html: cards._read_cards(html, None, tags), CARD)
    assert values == [[("https://g/maps/place/x", f"Bar {n}", f"4,{n}", "", "")] for n in range(50)]
    assert 0 < once == all_calls


def test_full_tables_start_afresh(monkeypatch):
    monkeypatch.setattr(pages, "_TAGS_KNOWN", 3)
    monkeypatch.setattr(pages, "_MOVES_KNOWN", 5)
    tags = pages._PlaceTags(pages.PLACE_SELECTORS)
    name = pages.PLACE_TEXTS.fieldNames().index("name")
    assert [pages._read_page(PLACE.format(n=n), tags)[name] for n in range(9)] == [[f"Bar {n}"] * 2 for n in range(9)]
    assert len(tags) <= 3 and tags.moves <= 30
