"""License notices against plain Python, and the plan for Python workers."""

import re

import pytest
from oracle import compare, connect

from timberline.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def scanned(doc_id, text):
    words = words_of(text)
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    labels, best = {label for _, label in places}, 0.0
    if text is not None:
        lines = text.split("\n")
        for i in range(max(1, len(lines) - licenses.BLOCK_LINES + 1)):
            block = set(words_of("\n".join(lines[i : i + licenses.BLOCK_LINES])))
            for label, template in licenses.TEMPLATES:
                sought = set(words_of(template))
                if 100 * len(sought & block) >= licenses.THRESHOLD * len(sought):
                    labels.add(label)
                    best = max(best, len(sought & block) / len(sought))
    starts = [s for s, _ in places]
    return (
        doc_id,
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
        ",".join(sorted(labels)),
        1.0 if places else best,
    )


NOTICE = (
    "Permission is hereby granted,\nfree of charge, to any person obtaining a copy of this software\n"
    "and associated documentation files\n(the \"Software\"), to deal in the Software without restriction"
)
TEXTS = [
    (1, "Released under the MIT License."),
    (2, "mit license MIT-LICENSE, mit\nlicense; the apache license and the general public license general public"),
    (3, None),
    (4, ""),
    (5, " \n\t\n ,;."),
    (6, "license mit"),
    (7, NOTICE),
    (8, NOTICE.replace("\n", "\n\n\n")),
    (9, "word " * 30_000 + "\nLicensed under CC BY-NC 4.0.\n" + "line\n" * 5000 + "Apache License"),
    (10, "Licensed under the BSD\nLicense"),
    (11, "licensed\nunder\nthe\nBSD\nlicense"),
    (12, "MİT license K mit licenſe naïve 你好 mit license"),
    (13, "Redistribution and use in source and binary forms, with or without changes, are permitted if the following conditions are met"),
    (13, "Redistribution and use in source and binary forms, with or without changes, are permitted if the following conditions are met"),
    (13, "Copyright 2020. All rights reserved"),
    (None, "Copyright 2020. All rights reserved"),
    (None, None),
    (None, "MIT License"),
]


@pytest.fixture(scope="module")
def docs(spark):
    names = ["text_hash", "block", "template", "held", "word", "places", "met", "score", "label", "lines"]
    made = spark.createDataFrame([(i, t, None, "s", 1) for i, t in TEXTS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return made.selectExpr("*", *[f"'clash' AS {c}" for c in names])


def test_scan_against_plain_python(docs):
    found = licenses.license_scan(docs)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((scanned(i, t) for i, t in TEXTS), key=str)


def test_scan_of_whole_table_against_plain_python(spark, documents, texts, sf_dir):
    found = queries.op12_license_join(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in found) == sorted(scanned(i, t) for i, t in texts.items())


def test_scan_against_sql_on_edges(spark, docs, tmp_path):
    docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates().where("doc_id <> 13").write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(tmp_path.parent / "none")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    case = next(c for c in queries.CASES if c.name == "op12_license_join")
    assert compare(spark, con, case, str(tmp_path)) == 12


def test_blocks_name_the_lines_and_the_template(docs):
    found = {(r.id, r.block, r.label, round(r.containment, 3)) for r in licenses.license_blocks(docs).collect()}
    assert {b for i, b, label, _ in found if (i, label) == (7, "mit")} == {0}
    assert not any(i == 8 for i, *_ in found)
    assert {b for i, b, label, _ in found if (i, label) == (9, "cc-by-nc")} == {0, 1}


def test_lower_threshold_finds_more(docs):
    loose = {r.id for r in licenses.license_blocks(docs, threshold=50).collect()}
    assert {r.id for r in licenses.license_blocks(docs).collect()} < loose


def test_of_nothing(docs):
    assert licenses.license_scan(docs.limit(0)).collect() == []
    assert licenses.license_blocks(docs.limit(0)).collect() == []
    assert licenses.license_blocks(docs, templates=()).collect() == []


def test_runs_without_python_workers(docs):
    plan = licenses.license_scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
