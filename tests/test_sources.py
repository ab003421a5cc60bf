import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.operators import entities as en, morphology as mo
from lexloom.sources import files as fl, html as ht, sinks as sk

PAGE = """<main><article><p>menu</p><header class="entry-headword"><b>Քար → քար (բույս չէ)</b></header><div><h4>Old glosses</h4>
<ol><li>plain row</li><li><em><a href="/w?n=7&amp;v=b">Glossary of stones</a></em> <i>քար — hard thing</i></li><li><a href="#top">up</a></li>
<li><a href="/w?n=9">Field notes</a></li><li><a href="/w?n=9">Field notes</a></li></ol></div></article></main>"""


def test_dictionary_page(spark):
    pages = spark.createDataFrame([(1, "https://d.example/s?q=1", PAGE), (2, "https://d.example/", "<p>nothing here</p>")], "page_id bigint, url string, html string")
    queries = spark.createDataFrame([(1, "քար"), (2, "քար")], "page_id bigint, query string")
    rows = ht.dictionary_results(pages, queries).orderBy("seq").collect()
    assert [(r.matched_form, r.match_type, r.source_title, r.reference_link, r.source_subtitle, r.snippet) for r in rows] == [
        ("Քար", "normalized", "Glossary of stones", "https://d.example/w?n=7&v=b", "Old glosses", "քար — hard thing"),
        ("Քար", "normalized", "Field notes", "https://d.example/w?n=9", "Old glosses", None),
    ]


def test_wordlist_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿Հայ\nգիր; բառ\n\n—\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Surface Form,Normalized-Form\nՏուն,\n,շուն\nՏուն,\n", encoding="utf-8")
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("ծառ; քար", "", "ջուր"))
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as box:
        box.writestr("word/document.xml", f'<w:document xmlns:w="{fl.WORD_NS[1:-1]}"><w:body>{body}</w:body></w:document>')
    got = {(r.surface_form, r.normalized_form, r.import_method) for r in fl.read_wordlists(spark, str(tmp_path)).collect()}
    assert got == {
        ("Հայ", "հայ", "txt"), ("գիր; բառ", "գիր; բառ", "txt"), ("Տուն", "տուն", "csv"), ("շուն", "շուն", "csv"),
        ("ծառ", "ծառ", "docx"), ("քար", "քար", "docx"), ("ջուր", "ջուր", "docx"),
    }
    (tmp_path / "D.TXT").write_text("ամպ\n", encoding="utf-8")
    assert ("ամպ", "txt") in {(r.surface_form, r.import_method) for r in fl.read_wordlists(spark, str(tmp_path)).collect()}
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError, match="pdf"):
        fl.read_wordlists(spark, str(tmp_path))
    bad = spark.createDataFrame([("f", "x", "y")], "file string, one string, two string")
    with pytest.raises(ValueError):
        fl.csv_entries(bad)


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("surface_form,normalized_form\nՏուն,տուն\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("normalized_form,note,surface_form\nքար,nn,Քար\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("word\nջուր\na whole sentence of words\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("surface_form,normalized_form\nԾառ,\n", encoding="utf-8")
    got = {(r.surface_form, r.normalized_form) for r in fl.read_csv(spark, str(tmp_path)).collect()}
    assert got == {("Տուն", "տուն"), ("Քար", "քար"), ("ջուր", "ջուր"), ("Ծառ", "ծառ")}


def test_pdf_lines(spark):
    rows = [("a", 1, "text", "x" * 45), ("a", 1, "ocr", "noise"), ("b", 1, "text", "short"), ("b", 1, "ocr", "գիր; բառ")]
    got = {(r.file, r.surface_form, r.import_method, r.warning is not None) for r in fl.pdf_entries(spark.createDataFrame(rows, "file string, page int, kind string, block string")).collect()}
    assert got == {("a", "x" * 45, "pdf_text", False), ("b", "գիր; բառ", "pdf_ocr", True)}


def test_sentences_and_entities(spark, tmp_path):
    (tmp_path / "train.conll").write_text("-DOCSTART- O\n\nԱրամ X B-PER\nԽան X I-PER\nեւ X O\nbad\n\nԵրևան B-LOC\nQ E-LOC\nR I-LOC\n", encoding="utf-8")
    rows = fl.read_sentence_files(spark, str(tmp_path)).withColumnRenamed("file", "source_id").withColumnRenamed("sentence_no", "seq")
    found = {(r.entity_surface, r.entity_type) for r in en.mentions(rows).collect()}
    assert found == {("Արամ Խան", "PER"), ("Երևան", "LOC"), ("R", "LOC")}
    bare = spark.createDataFrame([("s", 1, ["a", "b", "c"], ["PER", "PER", "I-ORG"])], "source_id string, seq int, tokens array<string>, labels array<string>")
    assert [(r.entity_surface, r.entity_type) for r in en.mentions(bare).orderBy("pos").collect()] == [("a", "PER"), ("b", "PER"), ("c", "ORG")]


def test_annotated_text(spark):
    texts = spark.createDataFrame([("s", "[[Տուն>>> տուն@n]] [[Գիր>>> ]] x [[Մեծերը>>>մեծ adj@x]]")], "source_id string, text string")
    got = {(r.surface, r.lemma) for r in fl.annotated_tokens(texts).collect()}
    assert got == {("տուն", "տուն"), ("գիր", "գիր"), ("մեծերը", "մեծ")}


def test_corpus_lookup_falls_back_to_lemmas(spark):
    tokens = spark.createDataFrame([("1", "տան", "տուն"), ("2", "տան", "տուն"), ("1", "տան", "տան")], "source_id string, surface string, lemma string")
    queries = spark.createDataFrame([("տան",), ("տուն",), ("չկա",)], "normalized_form string")
    got = {(r.normalized_form, r.lemma, r.token_count, r.source_count, r.lemma_rank) for r in en.corpus_lookup(queries, *en.corpus_index(tokens)).collect()}
    assert got == {("տան", "տուն", 2, 2, 1), ("տան", "տան", 1, 1, 2), ("տուն", "տուն", 2, 2, 1)}


def test_features(spark):
    rows = spark.createDataFrame([("Case=Nom,Acc|Number=Sing|Flag",), ("_",), ("Case=_|-",), (None,)], "v string")
    got = [r.f for r in rows.select(mo.parse_features(F.col("v")).alias("f")).collect()]
    assert got == [{"Case": ["Acc", "Nom"], "Number": ["Sing"], "Flag": ["true"]}, None, None, None]


def test_tagger_output(spark):
    lines = ["form\tlemma\tupos\tfeats", "# note", "տան\tտուն\tNOUN\tCase=Gen", "գիր\t_\tX\t_", "", "ես\tես\tPRON\t_"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, "տան\tտուն\tNOUN\tCase=Gen")], "file string, line_no int, line string")
    tagged = fl.tagger_rows(rows)
    got = {(r.file, r.sequence, r.position, r.token_surface, r.raw_lemma, r.raw_pos) for r in tagged.collect()}
    assert got == {("f", 0, 0, "տան", "տուն", "NOUN"), ("f", 0, 1, "գիր", "_", "X"), ("f", 1, 0, "ես", "ես", "PRON"), ("g", 0, 0, "տան", "տուն", "NOUN")}
    tokens = spark.createDataFrame([("f", 0, 0, "տան"), ("f", 0, 1, "գիր"), ("f", 1, 0, "ես"), ("f", 1, 1, "դու")], "file string, sequence int, position int, token_surface string")
    flags = {(r.sequence, r.position): r.problem for r in fl.align_predictions(tagged, tokens).collect()}
    assert flags == {(0, 0): None, (0, 1): None, (1, 0): "token_count_mismatch", (1, 1): "token_count_mismatch"}
    assert mo.batch_sizes([100, 100, 100, 1]) == [2, 2] and mo.batch_sizes([1] * 9) == [8, 1] and mo.batch_sizes([]) == []


def test_mapping_rows(spark):
    raw = spark.createDataFrame([("Եմ", "լինել", "eastern", "seed_curated", "1.0")], "surface_form string, dictionary_lemma string, language_profile string, source_type string, confidence string")
    r = fl.mapping_rows(raw).first()
    assert (r.normalized_surface_form, r.review_status, r.confidence) == ("եմ", "approved", 1.0)
    with pytest.raises(Exception, match="mapping row"):
        fl.mapping_rows(raw.withColumn("dictionary_lemma", F.lit(" "))).collect()


def test_merge_entities(spark):
    schema = "source_id string, normalized_surface string, entity_type string, entity_surface string, occurrence_count bigint, confidence double, sample_contexts array<string>"
    old = spark.createDataFrame([("s", "ա", "PER", "Ա", 2, 0.5, ["1", "2"])], schema)
    new = spark.createDataFrame([("s", "ա", "PER", "ա", 3, 0.85, ["2", "3", "4", "5", "6"]), ("s", "բ", "LOC", "Բ", 1, 0.85, ["x"])], schema)
    got = {r.normalized_surface: (r.entity_surface, r.occurrence_count, r.confidence, r.sample_contexts) for r in sk.merge_entity_entries(old, new).collect()}
    assert got == {"ա": ("Ա", 5, 0.85, ["1", "2", "3", "4", "5"]), "բ": ("Բ", 1, 0.85, ["x"])}


def test_files_in_many_splits(spark, tmp_path):
    """A file read in splits of a few dozen bytes gives the sentences and rows of reading it whole."""
    import random

    rng, text, tagged, want, rows = random.Random(4), [], ["form\tlemma\tGender"], {}, {}
    for name in ("a", "b", "c"):
        lines, sequence, cells = [], -1, [] if name == "a" else [tagged[0]]
        sentences, now = [], []
        for n in range(150):
            kind = rng.random()
            if kind < (0.0 if name == "c" else 0.3):
                lines.append(rng.choice(["", "  ", "\t"]))
                sentences += [now] if now else []
                now = []
            elif kind < 0.4:
                lines.append(rng.choice(["-DOCSTART- X O", "lonely"]))
            else:
                lines.append(f"բառ{n} X {rng.choice('OB')}")
                now.append((f"բառ{n}", lines[-1][-1]))
        sentences += [now] if now else []
        (tmp_path / f"{name}.conll").write_text("\n".join(lines) + "\n", encoding="utf-8")
        want[name] = sentences
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("250b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = fl.read_sentence_files(spark, str(tmp_path)).orderBy("file", "sentence_no").collect()
            for name, sentences in want.items():
                own = [r for r in got if r.file.endswith(f"{name}.conll")]
                assert [list(zip(r.tokens, r.labels)) for r in own] == sentences
                assert [r.sentence_no for r in own] == list(range(len(sentences)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_tagger_files_in_splits(spark, tmp_path):
    lines, want, sequence, position = ["form\tlemma\tGender"], [], 0, 0
    for n in range(120):
        if n % 7 == 6:
            lines += ["", "# note", ""]
            sequence, position = sequence + 1, 0
        lines.append(f"w{n}\tl{n}\t{'Fem' if n % 3 else '_'}")
        want.append((sequence, position, f"w{n}", f"l{n}", "Fem" if n % 3 else None))
        position += 1
    (tmp_path / "a.tsv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.tsv").write_text("word\n\n" + "\n".join(lines[1:]), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = fl.read_tagger_output(spark, str(tmp_path)).withColumn("f", mo.adapted_features(F.col("raw_features"), F.col("columns"))).collect()
            got = sorted((r.sequence, r.position, r.token_surface, r.raw_lemma, r.f and r.f.get("gender", [None])[0]) for r in rows if r.file.endswith("a.tsv"))
            assert got == sorted(want, key=lambda r: r[:2])
            assert sorted((r.sequence, r.position, r.raw_lemma) for r in rows if r.file.endswith("b.tsv")) == sorted((r[0], r[1], None) for r in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_flat_tagger_output_is_cut(spark):
    flat = spark.createDataFrame([("f", i, x) for i, x in enumerate(["ա\tA", "բ\tB", "գ\tC"])] + [("g", i, x) for i, x in enumerate(["ա\tA", "բ\tB"])], "file string, line_no int, line string")
    tokens = spark.createDataFrame([("f", 0, 0, "ա"), ("f", 1, 0, "բ"), ("f", 1, 1, "գ"), ("g", 0, 0, "ա"), ("g", 1, 0, "բ"), ("g", 1, 1, "x")], "file string, sequence int, position int, token_surface string")
    got = {(r.file, r.sequence, r.position): (r.raw_lemma, r.problem) for r in fl.align_predictions(fl.tagger_rows(flat), tokens).collect()}
    assert got == {
        ("f", 0, 0): ("A", None), ("f", 1, 0): ("B", None), ("f", 1, 1): ("C", None),
        ("g", 0, 0): (None, "token_count_mismatch"), ("g", 1, 0): (None, "token_count_mismatch"), ("g", 1, 1): (None, "token_count_mismatch"),
    }
