from framewright.operators import frames, text


def found(spark, sentence):
    docs = spark.createDataFrame([(1, sentence)], "doc_id long, text string")
    cands = frames.candidates(frames.annotated(text.tokens(text.gated(text.sentences(docs)))))
    return {(r.subject, r.object) for r in frames.longest(frames.frames(cands)).collect()}


def test_both_arguments(spark):
    assert found(spark, "the relation of x by y") == {("y", "x")}


def test_subject_comes_first(spark):
    assert found(spark, "my nice relation of Tim") == {("nice", "tim")}


def test_no_argument_gives_no_frame(spark):
    assert found(spark, "the relation is very good") == set()


def test_clean_and_gate(spark):
    docs = spark.createDataFrame([(1, "a_b\t  c  d ."), (2, None), (3, ""), (4, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in text.gated(text.sentences(docs)).collect()] == [(1, 0, "a b c d")]
