from shelfspark.llm.subjects import document_subjects, sentences, train

WORDS = {"law": ["court", "clause", "tribunal", "statute"], "pets": ["kitten", "leash", "kibble", "collar"], "music": ["guitar", "chord", "drum", "melody"]}


def text(subject, n, start=0):
    w = WORDS[subject]
    return " ".join(f"Check the {w[i % 4]} first, then the {w[(i + 1) % 4]}." if i % 2 else f"We compared {i} models by {w[i % 4]}." for i in range(start, start + n))


def labelled():
    rows = [(text(s, 6, k), {s: 1.0}) for s in WORDS for k in range(30)]
    wrong = [(text("law", 5, k), {"pets": 1.0}) for k in range(4)]
    return rows + wrong


def test_held_out_texts():
    models = train(labelled(), list(WORDS))
    fill = " Prices may change without a note."
    assert models.accept_all([text("law", 5, 50) + fill, text("pets", 4, 61), text("law", 3, 70) + " " + text("music", 3, 80), "", None, "See the menu. Accept all."]) == [
        ["law"], ["pets"], ["law", "music"], [], [], [],
    ]
    passing = text("pets", 9, 90) + " " + text("music", 1, 91)
    assert models.accept_all([passing]) == [["pets"]]


def test_clear_sentences_amid_plain_ones():
    models = train(labelled(), list(WORDS))
    fill = " Prices may change without a note. Orders leave within two days."
    assert models.accept_all([text("law", 1, 51) + fill, fill * 20 + text("pets", 1, 61) + fill * 20, fill * 9]) == [["law"], ["pets"], []]


def test_tables(spark):
    docs = [(i, t) for i, (t, _) in enumerate(labelled())] + [(900, None), (901, " "), (902, text("music", 5, 200)), (902, text("music", 5, 200))]
    labels = [(i, next(iter(s)), "a") for i, (_, s) in enumerate(labelled())] + [(None, "law", "a"), (1, None, "b"), (0, "law", "c"), (77777, "pets", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labeller string")
    sub = spark.createDataFrame([(s,) for s in WORDS] + [(None,)], "subject string")
    got = {(r.doc_id, r.subject) for r in document_subjects(d, lab, sub).collect()}
    assert (902, "music") in got and (0, "law") in got and not any(i in (900, 901) for i, _ in got)
    assert document_subjects(d, lab.limit(0), sub).count() == 0
    assert document_subjects(d.limit(0), lab, sub).count() == 0
    assert document_subjects(d, lab, sub.limit(0)).count() == 0


def test_sentences():
    assert sentences("<p>A b-c.</p> Ｄ e!") == [["a", "b", "c"], ["d", "e"]]
    assert sentences(None) == [] and sentences("...") == []
