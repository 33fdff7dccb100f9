"""The stages from a catalog to evaluation sets, on a small project folder."""

import json
import random

import pytest
from pyspark.sql import functions as F
from quillmill import __main__ as cli
from quillmill.functions.tokenizers import WordTokenizer
from quillmill.plans import stages
from quillmill.sources import readers

AUTHORS = {"Austen, Jane, 1775-1817": "Jane Austen", "Twain, Mark, 1835-1910": "Mark Twain", "Crane, Stephen": "Stephen Crane"}


def work(seed: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "he", "was", "house", "river", "night", "walked", "slowly", "taken", f"own{seed % 7}"]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(12, 16))).capitalize() + "."
    chapter = lambda k: f"CHAPTER {k}\n\n" + "\n\n\n".join(" ".join(sentence() for _ in range(4)) for _ in range(6)) + "\n\n"
    return f"The Project Gutenberg text\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n{''.join(chapter(k) for k in range(1, 7))}*** END OF THE PROJECT GUTENBERG EBOOK X ***\n"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    lines = ["Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves"]
    lines += [f'{10 * a + k},Text,,"Work {k} of {a}",en,"{name}",,,' for a, name in enumerate(AUTHORS, 1) for k in range(5)]
    (folder / "catalog.csv").write_text("\n".join(lines) + "\n")
    texts = {str(10 * a + k): work(10 * a + k) for a in range(1, 4) for k in range(5)} | {"10": "no marker"}
    table = spark.createDataFrame(list(texts.items()), "id string, text string")
    fetch = lambda works: works.join(table, F.col("pg_id") == F.col("id"), "left").drop("id")
    tally = stages.run_ingest(spark, str(folder), stages.IngestConfig(str(folder / "catalog.csv"), max_works=4), fetch)
    return folder, {r["cluster"]: r["chapters"] for r in tally.collect()}, fetch


def test_ingest(spark, root):
    folder, tally, fetch = root
    assert tally == {"plain-realist": 48, "victorian-formal": 24, "TOTAL": 72}
    manifest = readers.manifest(spark, f"{folder}/manifest")
    assert manifest.where("path = 'source/jane-austen/work-1-of-1/chapter-006.txt'").count() == 1
    again = stages.run_ingest(spark, str(folder), stages.IngestConfig(str(folder / "catalog.csv"), max_works=4), fetch)
    assert {r["cluster"]: r["chapters"] for r in again.collect()}["victorian-formal"] == 24
    manifest = readers.manifest(spark, f"{folder}/manifest")  # written anew
    assert manifest.select("path").distinct().count() == manifest.count()


def test_measures(spark, root):
    folder = str(root[0])
    profile = stages.run_profile(spark, folder)
    assert {r["author"] for r in profile.collect()} == set(AUTHORS.values())
    verdicts = stages.run_registers(spark, folder)
    assert {r["register"] for r in verdicts.collect()} == {"plain-realist", "victorian-formal"}
    assert stages.run_burrows(spark, folder, stages.BurrowsConfig(10)).count() == 2
    index = json.loads(next((root[0] / "burrows" / "index").glob("part-*")).read_text())
    assert index["mfw_n"] == len(index["mfw_words"]) == 10
    assert set(index["cluster_centroids"]) == {"plain-realist", "victorian-formal"}


def test_sets(spark, root):
    folder, tokenizer = str(root[0]), WordTokenizer()
    run = stages.BriefRunConfig("plain-realist", seq_len=128)
    first = stages.run_briefs(spark, folder, run, tokenizer).first()["briefs"]
    assert first >= 96
    assert stages.run_briefs(spark, folder, run, tokenizer).first()["briefs"] == first  # nothing is left to do
    tally = {r["author"]: r for r in stages.run_dataset(spark, folder, stages.DatasetConfig("plain-realist", seq_len=128), tokenizer).collect()}
    assert tally["TOTAL"]["total"] == 2 * 200 < first  # the cap of both authors
    assert tally["Mark Twain"]["test"] == round(tally["Mark Twain"]["total"] * 0.1)
    rows = readers.training_set(spark, f"{folder}/dataset/plain-realist", "train")
    assert rows.where("size(input_ids) <> 128 OR size(attention_mask) <> 128").isEmpty()
    attrition = stages.run_eval_briefs(spark, folder).first()
    assert attrition["raw"] == tally["TOTAL"]["test"]
    assert spark.read.json(f"{folder}/eval/register").count() == 2
    assert spark.read.json(f"{folder}/eval/instruction").count() <= 8
    n = spark.read.json(f"{folder}/eval/register").count() + spark.read.json(f"{folder}/eval/instruction").count()
    assert cli.main(["generate", "--root", folder, "--seed", "5", "--max-new-tokens", "9", "--provider", "quillmill.operators.generation:echo"]) == 0
    texts = spark.read.json(f"{folder}/generated").collect()
    assert len(texts) == n and all(r["generated"].split()[0] == "5" and len(r["generated"].split()) == 10 for r in texts)
    assert json.loads(next((root[0] / "generated.config").glob("part-*")).read_text())["top_p"] == 0.9


def test_classifier_and_command_line(spark, root):
    folder = str(root[0])
    assert cli.main(["classifier", "--root", folder, "--window", "50", "--features", "200", "--steps", "20"]) == 0
    report = {r["class"]: r["f1"] for r in spark.read.json(f"{folder}/classifier/report").collect()}
    assert set(report) == {"plain-realist", "victorian-formal", "accuracy", "macro avg", "weighted avg"}
    with pytest.raises(SystemExit):
        cli.main(["dataset", "--root", folder])
