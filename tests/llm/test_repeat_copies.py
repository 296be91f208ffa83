import random

from leadlake.llm.repeats import maximal_repeats


def test_groups_hold_the_copies_of_texts(spark):
    rng = random.Random(8)

    def noise(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, own = noise("abcdefgh", 110), noise("uvwxyz", 150)
    rows = [(i, noise("ijklmn", 80) + passage + noise("opqrst", 80)) for i in range(3)]
    rows += [(10, rows[1][1]), (None, rows[1][1]), (20, own), (21, own), (22, own[:90]), (23, own[:90])]
    found = maximal_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    covered = {(r.doc_id, i) for r in found for i in range(r.start, r.start + r.length)}
    assert covered >= {(d, i) for d in (0, 1, 2, 10, None) for i in range(80, 190)}
    whole = {(r.doc_id, r.first_doc) for r in found if (r.start, r.first_start, r.length) == (0, 0, 150)}
    assert whole == {(20, 20), (21, 20)}
    assert {r.doc_id for r in found if (r.start, r.first_start, r.first_doc, r.length) == (0, 0, 1, 270)} == {1, 10, None}
    assert not {r.doc_id for r in found} & {22, 23}
