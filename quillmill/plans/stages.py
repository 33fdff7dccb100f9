"""The stages from a catalog to evaluation sets, as they are run from the command line.

A project is a folder: every stage reads what earlier ones have left there and
leaves its own results. The defaults are those of the configuration classes.

- ``chapters``: a Parquet table of chapter bodies with their manifest's columns
- ``manifest``: JSON lines, one per chapter
- ``profile``, ``registers``, ``burrows``: measurements
- ``briefs``: JSON lines, appended to
- ``dataset/<register>``, ``classifier``, ``eval``: training and evaluation sets
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, tokenizers
from ..operators import burrows, chunking, classifier, dataset, evalset, generation, ingest, profile, registers
from ..sources import readers, writers
from ..sources.shared import exists, fresh_path, removed, saved


@dataclass(frozen=True)
class IngestConfig:
    catalog: str
    max_works: int = 10
    register: str | None = None
    text_urls: tuple[str, ...] = ()  #: with {id}


@dataclass(frozen=True)
class ProfileConfig:
    register: str | None = None
    top: int = 30
    least_count: int = 30
    least_ratio: float = 2.0


@dataclass(frozen=True)
class BriefRunConfig:
    register: str
    seq_len: int = 2048
    context_chars: int = 1500
    chapters_per_author: int = 50
    seed: int = 42


@dataclass(frozen=True)
class DatasetConfig:
    register: str
    seq_len: int = 2048
    cap: int = 200
    val_share: float = 0.10
    test_share: float = 0.10
    seed: int = 42
    eos: int = 2


@dataclass(frozen=True)
class BurrowsConfig:
    top: int = 150


@dataclass(frozen=True)
class ClassifierConfig:
    window: int = 500
    test_share: float = 0.20
    features: int = 20_000
    least_docs: int = 5
    c: float = 1.0
    steps: int = 1000
    seed: int = 42


@dataclass(frozen=True)
class EvalConfig:
    per_register: int = 2
    cap: int = 200
    val_share: float = 0.10
    test_share: float = 0.10
    seed: int = 42


def _chapters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/chapters")


def run_ingest(spark: SparkSession, root: str, c: IngestConfig, fetch: Callable[[DataFrame], DataFrame] = readers.fetched_texts) -> DataFrame:
    """New chapters and their tally. fetch adds text to works that have urls."""
    authors = registers.author_dimension(registers.registers(spark))
    authors = authors if c.register is None else authors.where(F.col("register") == c.register)
    works = ingest.author_works(ingest.catalog_works(readers.catalog(spark, c.catalog)), authors)
    seen = _chapters(spark, root).select(T.slug(F.col("author")).alias("author_slug"), "work_slug") if exists(spark, f"{root}/chapters") else None
    # Three times as many works are looked at as are kept: some have no text or no chapters.
    wanted = ingest.new_works(ingest.first_works(works, 3 * c.max_works), seen)
    urls = F.array(*(F.replace(F.lit(u), F.lit("{id}"), F.col("pg_id")) for u in c.text_urls)) if c.text_urls else F.array().cast("array<string>")
    fetched = fetch(wanted.withColumn("urls", urls)).where(ingest.is_fetched_text(F.col("text")))
    cut = ingest.chapters(fetched.withColumn("text", T.without_markers(F.col("text")))).persist()
    kept = ingest.first_works(cut.select("author", "position", "pg_id").distinct(), c.max_works).select("author", "pg_id")
    named = cut.join(F.broadcast(kept), ["author", "pg_id"]).join(F.broadcast(authors.withColumnRenamed("register", "cluster")), "author")
    rows = ingest.manifest(named).join(named.select("author", "pg_id", "chapter_num", F.col("body").alias("text")), ["author", "pg_id", "chapter_num"])
    rows.write.mode("append").parquet(f"{root}/chapters")
    writers.json_lines(_chapters(spark, root).drop("text"), f"{root}/manifest")
    cut.unpersist()
    return ingest.manifest_tally(readers.manifest(spark, f"{root}/manifest"))


def run_profile(spark: SparkSession, root: str, c: ProfileConfig = ProfileConfig()) -> DataFrame:
    chapters = registers.of_register(_chapters(spark, root), registers.registers(spark), c.register)
    stats = profile.chapter_stats(chapters.select("author", "text"))
    bigrams = profile.distinguishing_bigrams(profile.bigram_counts(chapters), top=c.top, least_count=c.least_count, least_ratio=c.least_ratio)
    writers.json_lines(profile.profile_documents(profile.author_profile(stats), bigrams), f"{root}/profile")
    return spark.read.json(f"{root}/profile")


def run_registers(spark: SparkSession, root: str) -> DataFrame:
    """The separation verdict of each register, from the rounded profiles as they are stored."""
    dimension = registers.registers(spark)
    quartiles = registers.axis_quartiles(spark.read.json(f"{root}/profile"), dimension)
    writers.json_lines(quartiles, f"{root}/registers/axes")
    writers.json_lines(registers.separation(quartiles).join(dimension.select(F.col("name").alias("register"), "display", "authors"), "register"), f"{root}/registers/verdicts")
    return spark.read.json(f"{root}/registers/verdicts")


def run_briefs(spark: SparkSession, root: str, c: BriefRunConfig, tokenizer: tokenizers.Tokenizer, factory: generation.Factory | None = None) -> DataFrame:
    """Briefs of the chunks that have none yet, appended. Without a provider they are extractive."""
    chapters = ingest.brief_sources(_chapters(spark, root), c.register, c.chapters_per_author, c.seed)
    chunks = chunking.chunk_documents(chapters, tokenizer, chunking.chunk_budget(c.seq_len), doc_id="path", decode=True)
    if exists(spark, f"{root}/briefs"):
        chunks = chunks.join(readers.briefs(spark, f"{root}/briefs").select("path", "chunk_idx"), ["path", "chunk_idx"], "left_anti")
    shown = chunks.select("path", "chunk_idx", "text")
    config = generation.BriefConfig(context_chars=c.context_chars)
    made = generation.extractive_briefs(shown) if factory is None else generation.synthesized_briefs(shown, factory, config)
    rows = made.join(chapters.select("path", "author", "cluster"), "path")
    rows.select(F.col("path").alias("chapter_path"), "chunk_idx", "brief", "author", "cluster").write.mode("append").json(f"{root}/briefs")
    return readers.briefs(spark, f"{root}/briefs").groupBy("cluster").agg(F.count("*").alias("briefs"))


def _split(chunks: DataFrame, briefs: DataFrame, c) -> DataFrame:
    return evalset.replayed_split(chunks, dataset.last_briefs(briefs), c.cap, c.val_share, c.test_share, c.seed)


def run_dataset(spark: SparkSession, root: str, c: DatasetConfig, tokenizer: tokenizers.Tokenizer) -> DataFrame:
    """The packed, labelled set of a register, by split, and its tally."""
    chapters = _chapters(spark, root).where(F.col("cluster") == c.register)
    chunks = chunking.chunk_documents(chapters, tokenizer, chunking.chunk_budget(c.seq_len), doc_id="path")
    briefs = readers.briefs(spark, f"{root}/briefs").where(F.col("cluster") == c.register)
    rows = _split(chunks.drop("n_tokens"), briefs, c).withColumn("register", F.lit(c.register))
    rows = tokenizers.encoded(dataset.with_prompts(rows, registers.registers(spark)), tokenizer, "prompt", "prompt_ids")
    packed = dataset.packed_rows(rows.withColumnRenamed("input_ids", "chunk_ids"), length=c.seq_len, eos=c.eos)
    numbered = packed.join(chapters.select("path", "pg_id"), "path").withColumn("first_seen", F.concat_ws("#", "path", F.format_string("%08d", "chunk_idx")))
    numbered = numbered.join(F.broadcast(dataset.author_vocabulary(numbered)), "author")
    shown = numbered.select("path", F.col("pg_id").cast("int").alias("chapter_id"), "chunk_idx", "author", "author_id", "is_chapter_end", "input_ids", "attention_mask", F.col("prompt_length").alias("prompt_lengths"), "n_tokens", "was_cut", "split")
    path = f"{root}/dataset/{c.register}"
    writers.training_set(shown, path, asdict(c))
    stored = spark.read.parquet(path)
    return dataset.split_tally(stored)


def run_burrows(spark: SparkSession, root: str, c: BurrowsConfig = BurrowsConfig()) -> DataFrame:
    """The index as one document; the Delta between every two registers."""
    chapters = _chapters(spark, root)
    counts = burrows.word_counts(chapters, "path").persist()
    words = burrows.frequent_words(counts, c.top)
    freqs = burrows.relative_frequencies(counts, words, "path")
    scaled = burrows.scale(freqs, words, burrows.chapter_count(counts, "path"))
    ids = counts.select("path").distinct().join(chapters.select("path", F.col("cluster").alias("register")), "path")
    vectors = burrows.chapter_vectors(freqs, scaled, ids, "path").persist()
    centres = burrows.centroids(vectors)
    writers.document(burrows.index_document(words, scaled, centres), f"{root}/burrows/index")
    writers.json_lines(burrows.cohesion(vectors, centres), f"{root}/burrows/cohesion")
    writers.json_lines(burrows.pairwise_delta(centres), f"{root}/burrows/delta")
    counts.unpersist()
    vectors.unpersist()
    return spark.read.json(f"{root}/burrows/delta")


def run_classifier(spark: SparkSession, root: str, c: ClassifierConfig = ClassifierConfig()) -> DataFrame:
    """A fitted model of registers and its report on held-out chapters."""
    chapters = _chapters(spark, root).select("path", "text", F.col("cluster").alias("label"))
    windows = classifier.word_windows(chapters, c.window, "path")
    rows = classifier.group_split(windows, c.test_share, c.seed, "path").select("label", "is_test", "window")
    train = rows.where("NOT is_test")
    terms = classifier.vocabulary(classifier.term_lists(train), train.agg(F.count("*").alias("n")), c.features, c.least_docs).persist()
    named = classifier.stored_vectors(classifier.tf_idf(classifier.term_lists(rows), terms), terms.count(), path := fresh_path(spark, "features"))
    fitted = classifier.train(named.where("NOT is_test").select("label", "features"), c=c.c, steps=c.steps)
    writers.model(fitted, f"{root}/classifier/model")
    predicted = fitted.transform(named.where("is_test")).select("label", "predicted").persist()
    writers.json_lines(classifier.confusion(predicted), f"{root}/classifier/confusion")
    writers.json_lines(classifier.class_report(predicted), f"{root}/classifier/report")
    for df in (terms, predicted):
        df.unpersist()
    removed(spark, path)
    return spark.read.json(f"{root}/classifier/report")


def run_eval_briefs(spark: SparkSession, root: str, c: EvalConfig = EvalConfig()) -> DataFrame:
    """Held-out briefs by register and with constraints; what the filters drop.

    The replayed split must be the stored one in every register that has a set.
    """
    briefs = readers.briefs(spark, f"{root}/briefs").withColumnRenamed("cluster", "register")
    last = dataset.last_briefs(briefs)
    split = _split(last.select("path", "chunk_idx"), briefs, c)
    stored = [n for (n,) in ((r["name"],) for r in registers.registers(spark).select("name").collect()) if exists(spark, f"{root}/dataset/{n}")]  # five names
    for name in stored:
        held = spark.read.parquet(f"{root}/dataset/{name}").select(F.lit(name).alias("register"), "split")
        if not evalset.split_differences(split.where(F.col("register") == name), held).where("NOT same").isEmpty():
            raise ValueError(f"the stored split of {name} differs from the replayed one")
    judged = saved(evalset.judged_briefs(evalset.test_briefs(last, split)))
    kept = judged.where("reason = 'kept'")
    row = [F.col("register").alias("source_register"), "brief", F.col("path").alias("source_chapter"), F.col("chunk_idx").alias("source_chunk_idx")]
    writers.json_lines(evalset.sampled(kept, c.per_register, c.seed).select("brief_id", "brief_key", *row), f"{root}/eval/register")
    writers.json_lines(evalset.instruction_probe(kept, evalset.constraints(spark), c.seed + 1).select("brief_id", *row, "constraint_id", "constraint_text"), f"{root}/eval/instruction")
    return evalset.attrition(judged)


def run_generate(spark: SparkSession, root: str, c: generation.GenerationConfig = generation.GenerationConfig(), factory: generation.Factory = generation.echo) -> DataFrame:
    """Texts for the held-out briefs of every register, by a provider; and whether each keeps its constraint."""
    shown = registers.registers(spark).select(F.col("name").alias("source_register"), "display")
    briefs = [spark.read.json(f"{root}/eval/{k}").select("brief_id", "source_register", "brief", *([] if k == "register" else ["constraint_id"])) for k in ("register", "instruction")]
    every = briefs[0].unionByName(briefs[1], allowMissingColumns=True).join(F.broadcast(shown), "source_register")
    made = generation.generated(every.withColumn("prompt", T.prompt(F.col("display"), F.col("brief"))), factory, c).drop("prompt", "display")
    writers.json_lines(made.withColumn("kept", evalset.checks_constraint("generated")), f"{root}/generated")
    writers.run_config(spark, c, f"{root}/generated.config")
    return spark.read.json(f"{root}/generated").groupBy("source_register").agg(F.count("*").alias("texts"))
