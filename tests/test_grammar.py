"""Rules over annotated tokens and plans, on small sentences with annotations as a tagger gives them."""

from pyspark.sql import functions as F

from quillmill.operators import annotated, resolution, review

TOKENS = "doc_id long, sentence long, idx long, token string, lemma string, pos string, dep string, head long"


def sentence(spark, *words, doc=1, number=1):
    """Words as (token, lemma, pos, dep, head)."""
    return spark.createDataFrame([(doc, number, i, *w) for i, w in enumerate(words)], TOKENS)


def test_negation_contrast_gives_each_negation(spark):
    """He did n't run and did not walk but was only just waiting: main verbs are no helpers, words count and not lemmas."""
    s = sentence(
        spark, ("He", "he", "PRON", "nsubj", 3), ("did", "do", "AUX", "aux", 3), ("n't", "not", "PART", "neg", 3), ("run", "run", "VERB", "ROOT", 3), ("and", "and", "CCONJ", "cc", 3), ("did", "do", "AUX", "aux", 7),
        ("not", "not", "PART", "neg", 7), ("walk", "walk", "VERB", "conj", 3), ("But", "but", "CCONJ", "cc", 3), ("was", "be", "VERB", "aux", 11), ("only", "only", "ADV", "advmod", 11), ("waiting", "wait", "VERB", "conj", 3),
        ("never", "never", "ADV", "neg", 11), ("butted", "but", "NOUN", "x", 3),
    )
    found = sorted((r.idx, r.negated, r.turn, r.verb) for r in annotated.negation_contrast(s).collect())
    assert found == [(2, 3, 8, 11), (6, 7, 8, 11)]
    lemma_only = sentence(spark, ("go", "go", "VERB", "ROOT", 0), ("not", "not", "PART", "neg", 0), ("buts", "but", "NOUN", "x", 0), ("run", "run", "VERB", "x", 0))
    assert annotated.negation_contrast(lemma_only).count() == 0


def test_pairs_are_in_the_order_read(spark):
    s = sentence(spark, ("Old", "Old", "ADJ", "amod", 1), ("boats", "boat", "NOUN", "nsubj", 2), ("took", "take", "VERB", "ROOT", 2), ("off", "off", "ADP", "prt", 2), ("slowly", "slowly", "ADV", "advmod", 2), ("nets", "net", "NOUN", "dobj", 2))
    assert sorted((r.pattern, r.pair) for r in annotated.dependency_patterns(s).collect()) == [("NOUN>amod", "old boat"), ("VERB>advmod", "slowly take"), ("VERB>dobj", "take net"), ("VERB>prt", "take off")]


def test_generic_verbs_need_an_object(spark):
    s = sentence(spark, ("She", "she", "PRON", "nsubj", 1), ("Made", "Make", "VERB", "ROOT", 1), ("tea", "tea", "NOUN", "dobj", 1), ("and", "and", "CCONJ", "cc", 1), ("cake", "cake", "NOUN", "obj", 1), ("went", "go", "VERB", "conj", 1), ("make", "make", "NOUN", "x", 1))
    assert [(r.idx, r.verb, r.object) for r in annotated.generic_verbs(s, ["make", "go"]).collect()] == [(1, "make", "tea")]


def test_quiet_intensity_and_similes(spark):
    s = sentence(spark, ("a", "a", "DET", "det", 2), ("Silent", "Silent", "ADJ", "amod", 2), ("Strength", "strength", "NOUN", "ROOT", 2), ("like", "like", "ADP", "prep", 2), ("an", "a", "DET", "det", 5), ("oak", "oak", "NOUN", "pobj", 3))
    assert [(r.lemma, r.head_lemma) for r in annotated.quiet_intensity(s).collect()] == [("Silent", "strength")]
    assert [(r.left_text, r.right_text) for r in annotated.similes(s).collect()] == [("a Silent Strength like an oak", "like an oak")]


def test_troponyms_have_their_greatest_depth(spark):
    lemmas = spark.createDataFrame([("go", "go"), ("go2", "go"), ("walk", "walk"), ("walk", "Go_on"), ("deep", "walk"), ("move", "move")], "synset string, lemma string")
    edges = spark.createDataFrame([("go", "move"), ("walk", "go"), ("go2", "walk"), ("deep", "go2")], "child string, parent string")
    found = annotated.troponyms(spark.createDataFrame([("GO",)], "verb string"), lemmas, edges)
    assert sorted((r.candidate, r.depth) for r in found.collect()) == [("go-on", 2), ("walk", 4)]


def test_stronger_verbs_are_ranked_by_four_places(spark):
    verbs = spark.createDataFrame([("go", 6.0, 2.0)], "word string, zipf double, concreteness double")
    rows = [("go", "stride", 3.0, 2.0, 0.50001, 1), ("go", "amble", 3.0, 2.0, 0.5, 1), ("go", "run", 5.9, 2.0, 0.9, 1), ("go", "soar", 3.0, 1.0, 0.9, 1)]
    found = annotated.stronger_verbs(verbs, spark.createDataFrame(rows, "word string, candidate string, zipf double, concreteness double, similarity double, depth int"))
    assert [(r.candidate, r.rank) for r in found.orderBy("rank").collect()] == [("amble", 1), ("stride", 2)]


def test_warnings_are_sentences_in_the_payload_s_order(spark):
    known = [("u1", "the captain", "Character", None, 1), ("u2", "Ada Stone", "Character", ["Ada"], 2), ("u3", "She", "Ghost", None, 3), ("u4", "the old miller", "Place", None, 4), ("u5", "the old mill", "Place", None, 5)]
    ontology = spark.createDataFrame(known, "uuid string, name string, type string, aliases array<string>, position long")
    rows = [(9, 1, "Ada", "Character", True), (3, 2, "Mara Voss", "Ghost", False), (7, 3, "old millers", "Place", False), (1, 4, "Nobody Known", "Thing", True), (2, 5, "Ada Stonee", "Person", False)]
    mentions = spark.createDataFrame(rows, "temp_id long, position long, name string, type string, is_new boolean")
    resolved = resolution.resolve(mentions, ontology, 0.8)
    out = [(r.colour, r.summary, r.details) for r in review.coloured(resolved, spark.createDataFrame([(1, "event", "a storm")], "position long, kind string, details string")).collect()]
    assert [x for x in out if x[0] == "yellow"] == [
        ("yellow", "is_new_mismatch", "Extractor flagged is_new=true but ontology had an exact match."), ("yellow", "name_promotion", "Upgrading generic placeholder 'She' to specific name 'Mara Voss'."),
        ("yellow", "name_promotion", "Fuzzy match 80.0% from generic 'the old miller' to specific 'old millers'."),
    ]
    assert ("green", "New entity", "Nobody Known (Thing)") in out and ("green", "New event", "a storm") in out
    assert [x[2] for x in out if x[0] == "red"] == ["Fuzzy match score 94.7% exceeds threshold"]


def test_subtree_sizes_are_those_of_the_subtrees_written_out(spark):
    """Trees, chains and circles, from a token table and from a sentence table; a long chain takes no square of its length."""
    heads = {1: [1, 1, 1, 2, 2], 2: [0, 0, 1, 2], 3: [1, 2, 0, 0, 3, 5, 5], 4: [0], 5: [3, 0, 0, 0]}
    tokens = spark.createDataFrame([(1, n, i, "t", "t", "X", "d", h) for n, own in heads.items() for i, h in enumerate(own)], TOKENS)
    own = annotated.subtrees(tokens, tokens.select("doc_id", "sentence", F.col("idx").alias("root"))).groupBy("doc_id", "sentence", "root").agg(F.count("*").alias("tokens"), F.max("idx").alias("last"))
    want = sorted(tuple(r) for r in own.collect())
    by_place = F.array_sort(F.collect_list(F.struct("idx", *annotated.WORD)))
    sentences = tokens.groupBy("doc_id", "sentence").agg(F.transform(by_place, lambda w: F.struct(*[w[c].alias(c) for c in annotated.WORD])).alias("words"))
    assert sorted(tuple(r) for r in annotated.subtree_sizes(tokens).collect()) == want
    assert sorted(tuple(r) for r in annotated.subtree_sizes(sentences).collect()) == want
    n = 200_000
    chain = spark.sql(f"SELECT 1L AS doc_id, 1L AS sentence, transform(sequence(0L, {n - 1}L), i -> struct('t' AS token, 't' AS lemma, 'X' AS pos, 'd' AS dep, greatest(0L, i - 1) AS head)) AS words")
    found = annotated.subtree_sizes(chain)
    assert found.agg(F.sum("tokens"), F.min("last"), F.count("*")).first() == (n * (n + 1) // 2, n - 1, n)


def _as_sentences(tokens):
    by_place = F.array_sort(F.collect_list(F.struct("idx", *annotated.WORD)))
    return tokens.groupBy("doc_id", "sentence").agg(F.transform(by_place, lambda w: F.struct(*[w[c].alias(c) for c in annotated.WORD])).alias("words"))


def _mixed(spark):
    """Two sentences of all sorts of words, with nulls and a head that isn't there."""
    rows = [(d, n, i, ["not", "But", "only", "n't", "go", "see"][(i * 7 + d + n) % 6], f"l{i % 5}", ["VERB", "NOUN", "AUX", None][(i * 5 + d) % 4], ["neg", "amod", "dobj", "aux", None][(i * 3 + n) % 5], (i * 11 + d) % 42) for d in (1, 2, 3) for n in (1, 2) for i in range(40)]
    return spark.createDataFrame(rows, TOKENS)


def test_negations_of_a_sentence_table_are_those_of_its_tokens(spark):
    tokens = _mixed(spark)
    want = sorted(map(tuple, annotated.negation_contrast(tokens).collect()))
    found = annotated.negation_contrast(_as_sentences(tokens))
    assert len(want) > 3 and sorted(map(tuple, found.collect())) == want
    assert "Join" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Window" not in plan


def test_heads_of_a_sentence_table_are_those_of_its_tokens(spark):
    tokens = _mixed(spark)
    columns = ["doc_id", "sentence", "idx", *annotated.WORD, "head_lemma", "head_pos"]
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows.select(*columns).collect())))
    found = annotated.with_heads(_as_sentences(tokens))
    assert len(key(found)) < tokens.count() and key(found) == key(annotated.with_heads(tokens))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, annotated.dependency_patterns(_as_sentences(tokens)).collect())) == sorted(map(tuple, annotated.dependency_patterns(tokens).collect()))
