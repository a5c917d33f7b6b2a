"""Rounds of refinement deal all anchors once, and lone anchors that stay among them repeat nothing."""

import random

from colloquy.llm import suffixes


def test_rounds_look_for_no_lone_anchors(spark, monkeypatch):
    rng, made, write = random.Random(3), [], suffixes.write_table

    def noted(df, name):
        made.append(name)
        return write(df, name)

    monkeypatch.setattr(suffixes, "write_table", noted)
    some = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    said, part = some(900), some(130)
    texts = [some(50) + said, said + some(70), some(400) + part + some(400), some(300) + part + some(300)]
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.spans] for r in got] == [[(50, 950)], [(0, 900)], [], []]
    # two rounds write pointers twice; buckets of one are looked for among pieces only, once for each cut of the two kinds
    assert made.count("suffix-finer") == 2 and made.count("suffix-live") == 4
