from pyspark.sql import functions as F

from leadlake.functions import diagnosis as dx

c = F.col
SCHEMA = "site string, ig string, phone string, rating double, reviews int, hours string"
ROWS = [
    ("a.com", "i", "1", 4.6, 250, "h"),
    (None, None, None, None, 0, None),
    (None, None, "1", 5.0, 5, None),
    ("a.com", None, None, 3.2, 12, "h"),
]
GOLDEN = [
    (77, "excellent", [], 100, ["Automação de atendimento"]),
    (77, "none", ["sem site", "sem telefone", "sem instagram", "poucas avaliações"], 0,
     ["Criação de site", "Google Meu Negócio", "WhatsApp Business", "Gestão de avaliações"]),
    (99, "poor", ["sem site", "sem instagram", "poucas avaliações", "alto potencial"], 33,
     ["Criação de site", "Gestão de redes sociais", "Google Meu Negócio", "Gestão de avaliações"]),
    (84, "good", ["sem telefone", "sem instagram", "poucas avaliações", "alto potencial"], 53,
     ["Gestão de redes sociais", "SEO / Otimização para buscas", "Tráfego pago (Google Ads)", "Google Meu Negócio", "WhatsApp Business"]),
]


def measured():
    return c("site"), c("ig"), c("phone"), c("rating"), c("reviews")


def test_goldens(column):
    links = lambda: (c("site"), c("ig"), c("phone"))
    score = column(lambda: dx.lead_score(*measured()), ROWS, SCHEMA)
    status = column(lambda: dx.digital_status(*links()), ROWS, SCHEMA)
    tags = column(lambda: dx.lead_tags(*links(), c("reviews"), dx.lead_score(*measured())), ROWS, SCHEMA)
    maturity = column(lambda: dx.digital_maturity(*measured(), c("hours")), ROWS, SCHEMA)
    services = column(lambda: dx.suggested_services(*measured()), ROWS, SCHEMA)
    assert list(zip(score, status, tags, maturity, services)) == GOLDEN


def test_zero_rating_counts_as_none_for_the_score_but_not_for_needs(column):
    rows = [("a.com", "i", "1", 0.0, 100, ""), ("a.com", "i", "1", None, 100, "")]
    assert column(lambda: dx.lead_score(*measured()), rows, SCHEMA) == [50, 50]
    assert column(lambda: dx.need_flags(*measured())["needs_seo"], rows, SCHEMA) == [True, False]


def test_diagnosis_struct(column):
    found = column(lambda: dx.digital_diagnosis(*measured(), c("hours"), F.array(F.lit("t"))), ROWS[:1], SCHEMA)[0].asDict()
    assert found == {
        "needs_website": False, "needs_seo": False, "needs_social_media": False, "needs_google_business": False,
        "needs_paid_traffic": False, "needs_redesign": False, "needs_automation": True, "digital_maturity_score": 100,
        "issues": ["t"], "suggested_services": ["Automação de atendimento"],
    }
