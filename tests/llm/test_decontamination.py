"""Copies of benchmark passages with foreign words between their own."""

import random

from noticelake.llm import decontamination

rng = random.Random(11)
WORDS = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(3000)]


def prose(n, r):
    return [r.choice(WORDS) for _ in range(n)]


def test_copies_are_found_with_up_to_a_passage_of_foreign_words_inside(spark):
    """Halves and thirds of items of 64 words, 40 to 60 foreign words apart, in longer documents; clean documents stay clean."""
    r = random.Random(5)
    items = [(i, " ".join(prose(64, r)) + ".") for i in range(40)]
    rows, want = [], set()
    for i, text in items:
        words = text.split()
        for k, cuts in enumerate(([32], [20, 44], [40])):
            gaps = [r.randint(40, 60) if len(cuts) == 1 else r.randint(34, 40) for _ in cuts]
            parts, at = prose(r.randint(0, 150), r), 0
            for cut, gap in zip(cuts, gaps):
                parts += words[at:cut] + prose(gap, r)
                at = cut
            rows.append((1000 + 10 * i + k, " ".join(parts + words[at:] + prose(r.randint(0, 150), r))))
            want.add((1000 + 10 * i + k, i))
    rows += [(n, " ".join(prose(300, r))) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
