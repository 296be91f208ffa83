import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadlake.llm.packing import WordIds, pack_documents, pieces
from leadlake.llm.pii import base_spans, candidates, digest, find_personal_data, redact
from leadlake.llm.quality import clean_lines

SCHEMA = "doc_id bigint, text string, lang string, words string, spans int, body string, base int, tokens string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "w", 1, "b", 2, "t") for i, t in enumerate(texts)], SCHEMA)


def random_texts(seed, n=120):
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "a b c a b c a b c", "x " * 4000, "no-space" * 2000, "l1.\nl1.\nl1.\n\nl2.", "é ü\x85ñ z"]
    for _ in range(n):
        lines = [" ".join(rng.choice(["aa", "b", "cé", "d#", "E"]) for _ in range(rng.randrange(12))) + rng.choice([".", "", "!"]) for _ in range(rng.randrange(15))]
        texts.append("\n".join(lines + lines[: rng.randrange(3)]))
    return texts


def test_base_rules_equal_brute_force(spark):
    texts = random_texts(4)
    found = {r.doc_id: r for r in clean_lines(table(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        words, places = WORDS.findall(text), defaultdict(list)
        for j in range(len(words) - 2):
            places[tuple(words[j : j + 3])].append(j)
        repeat = {j + k for p in places.values() if len(p) > 1 for j in p for k in range(3)}
        lines = [line for line in text.split("\n") if WORDS.search(line)]
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_lines_fail_for_their_own_reasons(spark):
    rng = random.Random(6)
    prose = "\n".join(" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(9)) + "." for _ in range(30))
    nav = "\n".join(["Home | News | Sport | Contact"] + [f"Menu item {i}" for i in range(60)])
    found = clean_lines(table(spark, [prose, prose + "\nHome\nWe use cookies on this page.", prose + "\n" + nav * 3, "SHOUTED LINES OF TEXT!\n" * 20])).orderBy("doc_id").collect()
    assert [r.kept for r in found] == [True, True, False, False]
    assert all("Home" not in r.clean_text for r in found[:3]) and "cookies" not in found[1].clean_text and found[0].clean_text == prose


def test_quality_of_nothing_and_native(spark):
    df = clean_lines(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((k, m.start(), m.end()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_the_expressions(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(["a", "@", "@", ".", "-", "1", "23", "4", " ", "+", "(", ")", "é", "255", "4111111111111111", "b.c"]) for _ in range(rng.randrange(40)))
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        base_spans(text)


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(3)
    texts = [f"hello there my number is +49 30 {rng.randrange(10**6, 10**7)} thanks" for _ in range(12)]
    texts += ["well my number is 030-5551234 thanks", "the version named 030-5551234 today", None, "", "order 12345 of 1999"]
    found = digest(find_personal_data(table(spark, texts))).orderBy("doc_id").collect()
    assert [r.n_phone for r in found] == [1] * 12 + [0] * 5
    assert found[12].spans == "phone:18:29" and found[12].n_added == 1
    assert [r.spans for r in found[13:]] == ["", "", "", ""]
    base = ",".join(f"phone:{a}:{b}" for _, a, b in plain_spans(texts[0]))
    assert found[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and found[0].spans == base
    clean = redact(table(spark, texts))
    assert clean.columns == table(spark, texts).columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[0] == "hello there my number is [phone] thanks" and kept[12] == "well my number is [phone] thanks"
    assert kept[13] == texts[13] and kept[14] is None and kept[15] == ""


def test_pii_of_nothing(spark):
    assert digest(find_personal_data(spark.createDataFrame([], SCHEMA))).count() == 0


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_tokenizers():
    plain, words = Tokenizer.from_file(TOKENIZER), WordIds(TOKENIZER)
    texts = [t or "" for t in random_texts(8)] + [
        "don't İstanbul we're ²½ ΟΔΟΣ 日本 <|endoftext|> a<|endoftext|>b l'été 12,5 x_y __ (a) \xa0b \x1c d ǅ ﬁ …»", "Été. 'quoted' éa ́b can't; STOP!!"]
    for text in texts:
        assert words.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 4095, 4096, 4097, 12345])
def test_pieces_are_powers_of_two(n):
    cuts = pieces(n, 4096)
    assert [a for a, _ in cuts] == [sum(size for _, size in cuts[:i]) for i in range(len(cuts))] and sum(size for _, size in cuts) == n
    assert all(size & (size - 1) == 0 and size <= 4096 for _, size in cuts)


def test_packing_round_trip(spark):
    texts = random_texts(9, 40)
    df = table(spark, texts + texts[:3]).repartition(3)
    plain = Tokenizer.from_file(TOKENIZER)
    rows = pack_documents(df, TOKENIZER, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_doc = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts + texts[:3]):
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        got = [x for r in sorted(by_doc[i], key=lambda r: r.start) for x in r.ids]
        assert got == want and all(r.doc_tokens == len(want) for r in by_doc[i])
    assert pack_documents(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_discovered_identifiers_make_patterns_of_their_own(spark):
    """A known number marks 'my number is'; what that discovers marks 'desk line', where no known number ever stands."""
    texts = [f"hello my number is +49 30 {1000000 + 7 * i} thanks" for i in range(200)]
    found = [f"030-55{10000 + 13 * i}" for i in range(20)]
    texts += [f"well my number is {n} thanks" for n in found] + [f"ring the desk line {n} today" for n in found]
    texts += ["ring the desk line 030-5599999 today", "the version named 030-5588888 today"]
    rows = {r.doc_id: r.spans for r in digest(find_personal_data(table(spark, texts))).collect()}
    assert [rows[i] for i in range(200, 220)] == ["phone:18:29"] * 20
    assert [rows[i] for i in range(220, 241)] == ["phone:19:30"] * 21
    assert rows[241] == ""


def test_grouped_numbers_are_candidates(spark):
    texts = [f"hello my number is +49 30 {1000000 + 7 * i} thanks" for i in range(40)] + [f"pay with card 41111111111{i:04}{d} now" for i in range(40) for d in range(10)]
    numbers = ["0170 555 12 34", "(030) 555-1234", "(030)555-1234", "030-5551234 12"]
    texts += [f"hello my number is {n} thanks" for n in numbers] + [f"hello my number is {n}, thanks" for n in numbers]
    cards = [(i, d) for i in range(40) for d in range(10) if luhn(f"41111111111{i:04}{d}")]
    texts = texts[:40] + [f"pay with card 41111111111{i:04}{d} now" for i, d in cards] + texts[440:] + ["pay with card 4111 1111 1111 1112 now", "the build 0170 555 12 34 today"]
    clean = {r.doc_id: r.text for r in redact(table(spark, texts)).collect()}
    n = 40 + len(cards)
    assert [clean[i] for i in range(n, n + 4)] == ["hello my number is [phone] thanks"] * 4
    assert [clean[i] for i in range(n + 4, n + 8)] == ["hello my number is [phone], thanks"] * 4
    assert clean[n + 8] == "pay with card [card] now" and clean[n + 9] == texts[n + 9]


def test_readings_inside_a_group_stay():
    """A token that could be found alone is a candidate still, beside the run it is part of; such a run is late."""
    def read(text):
        return {(c[0], c[7]) for c in candidates(text, base_spans(text))}

    assert read("host 10.1.2.300 8080 up") == {("10.1.2.300", False), ("10.1.2.300 8080", True)}
    assert read("call 030-5551234 5559999 now") == {("030-5551234", False), ("5559999", False), ("030-5551234 5559999", True)}
    assert read("in 1999. 2000 people of abc123 456 7890") == {("abc123", False), ("456 7890", False)}
    assert read("see 0170 5551 (12), yes") == {("0170 5551 (12)", False)}
    for text in ("1 " * 150_000, "1 1x " * 60_000, "((((1" * 60_000, "1(1)" * 80_000):
        candidates(text, [])


def test_a_worker_keeps_a_bounded_table_of_words():
    words, held = WordIds(public_tokenizers.path("word_bpe_49k.json")), []
    words.ids_of = lambda word: [1]
    for n in range(6):
        words.encode(" ".join(f"{n}x{i}" for i in range(100_000)).encode())
        held.append(len(words))
    # A few hundred bytes a word; workers stay alive between tasks and two share an executor's memory.
    assert max(held) <= 350_000
