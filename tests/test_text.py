import pytest
from pyspark.sql import functions as F
from quillmill.functions import text as T, tokenizers


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("Charlotte Brontë", "charlotte-bront"), ("--A  B!!", "a-b"), ("", ""), ("!!", "")])
def test_slug(spark, name, want):
    assert one(spark, T.slug, name) == want


@pytest.mark.parametrize(("name", "want"), [("M. R. James", ["R. James, M.", "James, M. R."]), ("Homer", ["Homer"]), ("Jane Austen", ["Austen, Jane"])])
def test_name_forms(spark, name, want):
    assert one(spark, T.name_forms, name) == want


@pytest.mark.parametrize("field", ["Brontë, Emily, 1818-1848", "Bronte, Emily"])
def test_names_match_whatever_the_accents(spark, field):
    assert one(spark, T.unaccented, "Brontë, Emily") in one(spark, T.unaccented, field)


def test_sentences_know_abbreviations(spark):
    assert one(spark, T.sentences, "Mr. Smith left. He ran.") == ["Mr. Smith left.", "He ran."]
    assert len(one(spark, T.pieces_by_sentence, "Mr. Smith left. He ran.")) == 3


def test_words(spark):
    assert one(spark, T.words, "Don't stop-it café") == ["Don't", "stop-it", "caf"]


def test_suffix_counts(spark):
    assert one(spark, T.adverbs, "élan ély xly ly") == 2
    assert one(spark, T.nominalizations, "station tion ation") == 1


def test_passive(spark):
    assert one(spark, T.is_passive, "It was quickly taken and is written.")
    assert one(spark, T.is_passive, "She's gone")
    assert not one(spark, T.is_passive, "He ran away.")


def test_last_character_of_a_quoted_sentence(spark):
    assert one(spark, T.last_char, 'He said "Go."') == '"'
    assert one(spark, T.last_char, "Go! ") == "!"


def test_speech(spark):
    assert one(spark, T.has_speech, "“Yes”, he said")
    assert not one(spark, T.has_speech, '""')


def test_bigrams_of_short_texts(spark):
    assert one(spark, lambda c: T.bigrams(T.words(c)), "one") == []
    assert [tuple(x) for x in one(spark, lambda c: T.bigrams(T.words(c)), "a b c")] == [("a", "b"), ("b", "c")]


def test_space_words(spark):
    assert [one(spark, T.space_words, s) for s in ("", " ", "a", " a  b\n c d ")] == [0, 0, 1, 4]


def test_markers(spark):
    text = "x\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\n body \n*** END OF THIS PROJECT GUTENBERG EBOOK A\nend"
    assert one(spark, T.without_markers, text) == "body"
    assert one(spark, T.without_markers, " plain ") == "plain"


def test_brief_cleanup(spark):
    assert one(spark, T.clean_brief, 'Summary: "A man walks."\nx') == "A man walks."
    assert one(spark, T.clean_brief, "") == ""


def test_prompt_and_response(spark):
    prompt = one(spark, T.prompt, "Plain realism", "A man walks.")
    assert prompt == "[INST] Continue this scene in Plain realism style: A man walks. [/INST] "
    assert one(spark, T.response, "a [/INST] b [/INST] c") == "b [/INST] c"
    assert one(spark, T.response, "no end") == "no end"
    assert one(spark, T.baseline_prompt, None, "x").endswith("\n\nx\n\nBegin the scene now. [/INST]")


@pytest.mark.parametrize(("brief", "leaked"), [("A 1910 edition of tales", True), ("edited by someone", True), ('"Emma" by "Other Tales" by someone', True), ("A man walks home", False)])
def test_leakage(spark, brief, leaked):
    assert one(spark, T.is_leaked, brief) is leaked


def test_titles(spark):
    assert one(spark, T.is_not_prose, "Poems of youth")
    assert not one(spark, T.is_not_prose, "A universe")


def test_word_tokenizer_has_the_same_ids_in_both_forms(spark):
    text = "Don't go, 42 cafés!"
    t = tokenizers.WordTokenizer()
    assert one(spark, tokenizers.token_ids, text) == t.encode(text)
    assert one(spark, tokenizers.token_count, text) == len(t.encode(text))
    assert t.decode(t.encode("a b")) == "a b"
