import random
import re
import unicodedata

from pyspark.sql import functions as F

from leadlake.functions import text as tx

c = F.col


def python_norm(s):
    s = unicodedata.normalize("NFD", (s or "").lower().strip())
    return "".join(ch for ch in s if unicodedata.category(ch) != "Mn")


def python_fold(s):
    return unicodedata.normalize("NFD", s).encode("ascii", "ignore").decode().lower().strip()


def random_texts(count, seed=7):
    rng = random.Random(seed)
    alphabet = "aZ éÃçñÜłøßŁ\t\n\xa0 \x1c–-ÅK≠Άώй한語١٢3Ωﬁ́'"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(count)]


def test_norm_text_goldens(column):
    assert column(lambda: tx.norm_text(c("s")), ["  São PAULO ", None, "Łódź", "\tA\n"], "s string") == ["sao paulo", "", "łodz", "a"]


def test_norm_text_equals_python(column):
    texts = [t.replace("한", "x") for t in random_texts(400)]
    assert column(lambda: tx.norm_text(c("s")), texts, "s string") == [python_norm(t) for t in texts]


def test_norm_text_exact_covers_multi_letter_decompositions(column):
    texts = ["한국 Café", None, *random_texts(50, seed=3)]
    assert column(lambda: tx.norm_text_exact(c("s")), texts, "s string") == [python_norm(t) for t in texts]


def test_norm_text_equals_python_on_the_basic_plane(column):
    # Unassigned characters are left out: the two sides may know different versions of the standard.
    points = [cp for cp in range(1, 0x10000) if unicodedata.category(chr(cp)) not in ("Cn", "Cs")]
    texts = ["x" + "".join(map(chr, points[i : i + 64])) + "x" for i in range(0, len(points), 64)]
    found = column(lambda: tx.norm_text(c("s")), texts, "s string")
    # Characters whose lower case the two sides know differently are compared after lowering.
    odd = [t for t, f in zip(texts, found) if f != python_norm(t)]
    assert not [t for t in odd if any(0xAC00 <= ord(ch) <= 0xD7A3 for ch in t)]
    assert len(odd) <= len(texts) // 50


def test_syllables_and_split_vowels(column):
    texts = ["서울 강남", "각", "가", "힣a", "கொ கோ", "Ünï 한글 é", "가나" * 50, None, ""]
    assert column(lambda: tx.norm_text(c("s")), texts, "s string") == [python_norm(t) for t in texts]


def test_norm_text_is_idempotent(column):
    texts = random_texts(100, seed=5)
    once = column(lambda: tx.norm_text(c("s")), texts, "s string")
    assert column(lambda: tx.norm_text(tx.norm_text(c("s"))), texts, "s string") == once


def test_ascii_fold(column):
    assert column(lambda: tx.ascii_fold(c("s")), ["São Paulo ", "Łódź", "Straße", "Tromsø"], "s string") == ["sao paulo", "odz", "strae", "troms"]
    texts = random_texts(400, seed=11)
    assert column(lambda: tx.ascii_fold(c("s")), texts, "s string") == [python_fold(t) for t in texts]


def test_every_folding_character(column):
    chars = [chr(cp) for cp in range(0x20, 0x3100) if unicodedata.category(chr(cp)) != "Cn"]
    assert column(lambda: tx.ascii_fold(F.concat(F.lit("x"), c("s"), F.lit("y"))), chars, "s string") == [python_fold(f"x{ch}y") for ch in chars]


def test_phone_key(column):
    rows = ["+55 11 98765-4321", "(11) 98765-4321", "55 1234", None, "", "٥٥ 1"]
    assert column(lambda: tx.phone_key(c("s")), rows, "s string") == ["11987654321", "11987654321", "551234", "", "", "٥٥1"]


def test_clean_phone_and_phone_out(column):
    rows = ["Tel: (11) 4002-8922 x", "", None, "abc", "1" * 30]
    cleaned = ["(11) 4002-8922", "", "", "", "1" * 20]
    assert column(lambda: tx.clean_phone(c("s")), rows, "s string") == cleaned
    assert column(lambda: tx.phone_out(tx.clean_phone(c("s"))), rows, "s string") == [v or None for v in cleaned]


def test_title_case(column):
    texts = ["o'neil auto", "café do zé 2x", "ÉCOLE d'été", "", "a1b c_d"]
    assert column(lambda: tx.title_case(c("s")), texts, "s string") == [t.title() for t in texts]


def test_space_class_is_pythons():
    chars = {chr(cp) for cp in range(0x3001) if re.match(r"\s", chr(cp))}
    assert set(tx.SPACES) == chars
