import random
import re
from urllib.parse import quote_plus

from pyspark.sql import functions as F

from leadlake.functions import fields as fx
from leadlake.functions import search as sx

c = F.col


def test_first_non_empty(column):
    rows = [(" ", "b ", "c"), (None, "", "c"), (None, None, " ")]
    assert column(lambda: fx.first_non_empty(c("x"), c("y"), c("z")), rows, "x string, y string, z string") == ["b", "c", ""]


def test_phone_from_label(column):
    rows = [("1", "Tel: 2"), ("", "Phone: (11) 2: 3 "), (None, "no colon"), ("", None)]
    assert column(lambda: fx.phone_from_label(c("p"), c("l")), rows, "p string, l string") == ["1", "3", "no colon", ""]


def test_first_external_href(column):
    rows = [["", "https://www.google.com/x", " https://a.com "], ["https://www.google.com"], []]
    assert column(lambda: fx.first_external_href(c("h")), rows, "h array<string>") == ["https://a.com", "", ""]


def test_canonical_site(column):
    rows = ["https://a.com/", "http://a.com/?x=1", "https://a.com/p?x", "", None, "https://a.com//"]
    assert column(lambda: fx.canonical_site(c("s")), rows, "s string") == ["a.com", "a.com/", "a.com/p", None, None, "a.com"]


def test_pick_instagram(column):
    rows = [["https://www.instagram.com/", "https://www.instagram.com/loja/?hl=pt"], ["https://x.com"], [],
            ["https://instagram.com/", "https://www.instagram.com/b"]]
    assert column(lambda: fx.pick_instagram(c("l")), rows, "l array<string>") == [
        "https://www.instagram.com/loja", None, None, "https://instagram.com"]


def test_parse_rating(column):
    rows = ["4,5", "4.5", "12", ",", None, "nota 3,9 de 5", "1,2,3", "٤,٥"]
    assert column(lambda: fx.parse_rating(c("s")), rows, "s string") == [4.5, 4.0, None, None, None, 3.9, None, 4.5]


def test_review_counts(column):
    labels = [["1.250 avaliações"], ["1,250 reviews"], ["4,5 estrelas"], ["x", "12 Reviews", "13 reviews"], [], [". avaliações", "7 review"]]
    assert column(lambda: fx.parse_review_count(c("l")), labels, "l array<string>") == [1250, 1250, 0, 12, 0, 7]
    rows = [(0, ["4,5", "1.250"]), (0, ["0", " ", "(31)"]), (9, ["5"]), (0, [])]
    assert column(lambda: fx.review_count_from_spans(c("n"), c("s")), rows, "n int, s array<string>") == [1250, 31, 9, 0]


def test_category_hours_photo(column):
    assert column(lambda: fx.category_or_keyword(c("x"), c("k")), [("", "o'neil auto"), ("Bar", "x")], "x string, k string") == ["O'Neil Auto", "Bar"]
    assert column(lambda: fx.hours_first_line(c("s")), ["  Aberto\nFecha", "", None, "x" * 70], "s string") == ["Aberto", None, None, "x" * 60]
    base = "https://lh5.googleusercontent.com/p/abc"
    rows = [["https://x.y/z.png", f" {base}=w80-h92-k-no"], [base], ["https://ggpht.com/a"], []]
    assert column(lambda: fx.pick_photo(c("p")), rows, "p array<string>") == [f"{base}=w400-h300-k-no", base, None, None]


def test_city_state_neighborhood(column):
    rows = [
        ("Rua X, 12 - Centro, São Paulo - SP, 01000-000", "Santos", "", "BR"),
        ("Rua X, 12 - Centro, Curitiba - XX", "Santos", "", "BR"),
        ("Rua X, 12 - Centro, Curitiba - PR", "Porto", None, "PT"),
        ("", "Porto", None, "PT"),
        ("A - B, Recife - PE, Olinda - PE", "Natal", "RN", "BR"),
    ]
    schema = "a string, c string, s string, k string"
    found = column(lambda: fx.parse_city_state(c("a"), c("c"), c("s"), c("k")), rows, schema)
    assert [tuple(r) for r in found] == [("São Paulo", "SP"), ("Santos", "SP"), ("Porto", ""), ("Porto", ""), ("Olinda", "PE")]
    assert column(lambda: fx.parse_neighborhood(c("a")), ["Rua X, 12 - Centro, São Paulo - SP", "", None, "a - , b"], "a string") == ["Centro", None, None, ""]
    assert column(lambda: fx.city_confirmed(c("a"), c("c"), c("k")), [(r[0], r[1], r[3]) for r in rows] + [("perto de SÃO  paulo e santos", "Santos", "BR")],
                  "a string, c string, k string") == [True, False, False, True, True, True]


def test_city_pairs_equal_python_on_random_addresses(column):
    rng = random.Random(1)
    parts = ["São João", "A", "B ", " - ", ", ", "–", "SP", "RJ", "XX", "SPA", "12", "Embu-Guaçu", "d'Oeste", "-", ",", " ", "x.", "PE9", "\xa0"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 12))) for _ in range(500)]
    pattern = r"[,\-–]\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\'\-\.]{1,38}?)\s*[,\-–]\s*([A-Z]{2})\b"

    def expected(address):
        valid = [(m[0].strip(), m[1]) for m in re.findall(pattern, address) if m[1] in fx.BR_STATES and 2 <= len(m[0].strip()) <= 40]
        return valid[-1] if valid else ("?", "SP")

    found = column(lambda: fx.parse_city_state(c("a"), F.lit("?"), F.lit(""), F.lit("BR")), rows, "a string")
    assert [tuple(r) for r in found] == [expected(a) for a in rows]


def test_search_keys_and_urls(column):
    assert column(lambda: sx.search_hash(c("k"), c("c"), c("s"), c("x")), [("A ", "b", "SP", "br")], "k string, c string, s string, x string") == ["2cba69b397f49df2"]
    rows = [("padaria & bar~*", "São Paulo", "SP"), ("x", "y", ""), ("x", "y", None)]
    expected = [sx.SEARCH_URL + quote_plus(" ".join(p for p in r if p)) for r in rows]
    assert column(lambda: sx.search_query_url(c("k"), c("c"), c("s")), rows, "k string, c string, s string") == expected
    assert column(lambda: sx.place_key(c("u")), [" HTTPS://A/ ", "https://a/"], "u string")[0] == column(lambda: sx.place_key(c("u")), ["https://a/"], "u string")[0]
    assert column(lambda: sx.classify_captcha(c("h")), ["<p>Detected UNUSUAL traffic", "ok", None, "g-reCAPTCHA"], "h string") == [True, False, False, True]


def test_progress(column):
    assert column(lambda: sx.progress_pct(c("n"), c("m")), [(20, 20), (5, 20), (1, 0), (7, 30)], "n int, m int") == [99, 25, 0, 23]
    rows = [(0, 20, "init", ""), (0, 20, "finding", ""), (3, 20, "finding", ""), (3, 20, "extracting", "x" * 30), (3, 20, "extracting", ""),
            (3, 20, "done", ""), (1, 20, "", ""), (3, 20, "", ""), (18, 20, "", ""), (0, 0, "", "")]
    assert column(lambda: sx.stage_message(c("n"), c("m"), c("p"), c("x")), rows, "n int, m int, p string, x string") == [
        "Iniciando navegador…", "Encontrando empresas…", "Encontrando empresas… (3 locais encontrados)",
        f"Extraindo contatos: {'x' * 28}… (3/20)", "Extraindo contatos… (3/20)", "Concluído — 3 leads coletados", "Encontrando empresas…",
        "Extraindo contatos… (3/20)", "Coletando locais… (18 encontrados)", "Encontrando empresas…"]
