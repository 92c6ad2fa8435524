"""What the language fit sees of a table with copies."""

import random

from banstream.llm import language_id


def test_the_fit_sees_each_text_once_and_every_language(spark, monkeypatch):
    random.seed(3)
    seen = []
    fit = language_id.fit_ftrl
    monkeypatch.setattr(language_id, "fit_ftrl", lambda rows, labels, *how: seen.extend(labels.tolist()) or fit(rows, labels, *how))
    few = ["zar kvo mip", "kvo zar zar", "mip kvo zar"]
    made = [(few[i % 3], "xx") for i in range(900)]
    made += [(" ".join(random.choices("the and with this from which their".split(), k=12)), "en") for _ in range(600)]
    made += [("le les des dans", "fr")] * 500 + [(f"pour avec sont {'l' * i}", "fr") for i in range(1, 10)]
    model = language_id.train(spark.createDataFrame(made, "text string, lang string").repartition(3), rows_per_language=20)
    assert model.languages == ("en", "fr", "xx")
    # a fifth of each language sets the temperature
    assert [seen.count(i) for i in range(3)] == [16, 8, 3]
    assert [model.languages[p.argmax()] for p in model.scores(few)] == ["xx"] * 3
