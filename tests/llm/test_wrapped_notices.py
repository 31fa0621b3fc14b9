"""License notices that go over several lines, and templates longer than a block."""

import textwrap

from folioscan.llm import licenses as m


def scan(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in m.license_scan(df, **options).collect()}


def test_wrapped_notices(spark):
    templates = list(m.TEMPLATES)
    texts = []
    for t in templates:  # behind so many words that the notice lies over the edge of a block
        for before in (0, 20, 50):
            texts.append("word " * before + "\n" + "\n".join(f"# {line}" for line in textwrap.wrap(t, 24)) + "\n" + "word " * 90)
    got = scan(spark, texts)
    for i, t in enumerate(templates):
        for k in range(3):
            r = got[3 * i + k]
            assert m.TEMPLATES[t] in r.labels.split(",") and r.score == 1.0


def test_mit_notice_as_commonly_wrapped(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    r = scan(spark, [text])[0]
    assert (r.labels, r.base_labels, r.score) == ("mit", "", 1.0)


def test_template_longer_than_a_block(spark):
    long = " ".join(f"t{i}" for i in range(150))
    got = scan(spark, ["x " * 77 + long + " y" * 200, "x"], templates={long: "long"})
    assert (got[0].labels, got[0].score) == ("long", 1.0) and (got[1].labels, got[1].score) == ("", 0.0)
