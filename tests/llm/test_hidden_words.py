from leadlake.llm.toxicity import FEATURES, HIDDEN, Measurer


def test_words_hidden_by_dots_count():
    measure = Measurer({"idiot": 1.0})
    for text in ("you are an i.d.i.o.t and nothing more.", "you are an i.d.i.o.t, and no one's friend", "ends. Starts", "a..b", "plain, text.", "é.f"):
        found = dict(zip(FEATURES, measure(text)))
        assert found["hidden_rate"] * len(text.split()) == len(HIDDEN.findall(text.lower())), text
        assert found["hidden_hits"] == ("i.d.i.o.t" in text)
