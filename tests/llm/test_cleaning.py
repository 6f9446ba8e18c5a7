"""Line dedup, quality rules, mixing: against plain Python over the same rows."""

import random
import re
from collections import Counter, defaultdict

import corpus_rows as cases
import pytest
from pyspark.sql import functions as F

from tillroll.llm import line_dedup, mixing, quality, registry
from tillroll.plans.staging import stage

ALL = cases.rows()


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


def plain_line_dedup(rows, ratio, allowance=line_dedup.ALLOWANCE):
    pages, on = Counter(), defaultdict(Counter)
    for host, text in {(r[3], r[1]) for r in rows}:  # equal texts of a host are one page
        pages[host] += 1
        on[host].update({x.strip(" \t\r") for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, _, host, _ in rows:
        if text is None:
            out.append((i, host, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [
            x for x in lines if not on[host][x.strip(" \t\r")] - allowance > ratio * pages[host]
        ]
        out.append((i, host, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("ratio", [0.02, 0.1, 0.5])
def test_lines_on_too_many_pages_go(corpus, ratio):
    got = line_dedup.drop_boilerplate(corpus, max_ratio=ratio, counts=("n_lines", "n_dropped"))
    assert got.columns[: len(corpus.columns)] == corpus.columns
    found = got.select("doc_id", "source", "n_lines", "n_dropped", "text").collect()
    assert as_counter(found) == as_counter(plain_line_dedup(ALL, ratio))
    assert got.filter("kept <> 'my kept'").count() == 0


def documents_folder(spark, folder, rows):
    cases.table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_copies_of_a_clean_text_keep_it(spark, tmp_path):
    """The registered query: 30 copies among 430 rows of one source."""
    rng = random.Random(6)
    clean = [(i, cases.prose(rng, 90), "en", "site", 1) for i in range(400)]
    copied = cases.prose(rng, 90) + "\n" + cases.prose(rng, 20)
    rows = clean + [(1000 + i, copied, "en", "site", 1) for i in range(30)]
    rows += [(2000 + i, f"Subscribe now\n{cases.prose(rng, 30)}", "en", "site", 1) for i in range(40)]
    got = {r.doc_id: r for r in registry.op1_line_dedup(spark, documents_folder(spark, tmp_path, rows)).collect()}
    assert all(got[1000 + i].text == copied for i in range(30))
    assert all(got[2000 + i].n_dropped == 1 for i in range(40))
    assert all(got[i].n_dropped == 0 for i in range(400))


def test_a_third_of_junk_copies_goes_in_the_query(spark, tmp_path):
    rng = random.Random(8)
    clean = [(i, cases.prose(rng, 120), "en", "site", 1) for i in range(100)]
    text = " ".join(w + "#$%" for w in cases.prose(rng, 120).split())
    rows = clean + [(1000 + i, text, "en", "site", 1) for i in range(50)]
    got = registry.op5_quality(spark, documents_folder(spark, tmp_path, rows)).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(100))


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.sub(r"[\x20\x09-\x0D]", "", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(inside),
    )


def test_base_counts(corpus):
    got = corpus.select("doc_id", quality.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    assert as_counter(got.collect()) == as_counter((r[0], *plain_counts(r[1])) for r in ALL)


def test_junk_goes_and_clean_text_stays(spark, corpus):
    junk = [(5000 + i, " ".join(w + "#$%" for w in ALL[i][1].split()), "en", "hot", 1) for i in (2, 8)]
    docs = cases.table(spark, ALL + junk, clashing=True)
    got = {r["id"]: r for r in quality.with_verdict(docs).select(
        F.col("doc.doc_id").alias("id"), F.col("doc.row").alias("mine"), "n_words", "base_failed", "kept").collect()}
    assert not any(got[j[0]]["kept"] for j in junk)
    assert all(r["mine"] == "my row" for r in got.values())
    ordinary = [r for r in got.values() if r["id"] is not None and r["id"] < 60 and not r["base_failed"]]
    assert len(ordinary) > 40 and all(r["kept"] for r in ordinary)
    assert all(r["base_failed"] and not r["kept"] for r in got.values() if r["n_words"] < 50)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns


def test_a_third_of_junk_copies_goes(spark):
    rng = random.Random(9)
    clean = [(i, cases.prose(rng, 120), "en", "site", 1) for i in range(100)]
    text = " ".join(w + "#$%" for w in cases.prose(rng, 120).split())
    junk = [(1000 + i, text, "en", "site", 1) for i in range(50)]
    kept = quality.keep_quality(cases.table(spark, clean + junk)).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in clean}


def test_concentration_ends_when_no_determinant_falls(spark):
    rng = random.Random(4)

    def vector(i):
        at = 0.0 if i % 2 else 2.5
        return ("en", "s", *(at + rng.gauss(0, 0.9 if at else 1.2) for _ in range(quality.P)))

    rows = [vector(i) for i in range(600)]
    names = ", ".join(f"x{i} double" for i in range(quality.P))
    vectors = spark.createDataFrame(rows, f"lang string, source string, {names}").cache()

    def centre(steps):
        return quality.group_estimates(vectors, steps=steps).first()["m0"]

    ended = centre(None)
    assert ended == pytest.approx(centre(40), abs=1e-9)
    assert ended != pytest.approx(centre(3), abs=1e-3)


def test_a_concentration_step_is_one_pass(spark, monkeypatch):
    rows = [("en", "s", *(0.1 * (i * k % 7) for k in range(1, quality.P + 1))) for i in range(40)]
    names = ", ".join(f"x{i} double" for i in range(quality.P))
    vectors = spark.createDataFrame(rows, f"lang string, source string, {names}")
    staged = []

    def counted(df, name):
        staged.append(name)
        return stage(df, name)

    monkeypatch.setattr(quality, "stage", counted)
    quality.group_estimates(vectors, steps=3).collect()
    assert staged == ["medians", "spreads", *["mcd"] * 5]


def test_chi_square_and_steps():
    assert quality.chi2_quantile(0.975, 4) == pytest.approx(11.1433, abs=1e-3)
    assert quality.chi2_quantile(0.5, 4) == pytest.approx(3.35669, abs=1e-4)
    assert quality._consistency(0.5) > quality._consistency(0.75) > 1


def plain_targets(sizes, weights=(3, 1, 2)):
    """Share, stop at twice the size, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= above


def test_every_source_meets_its_target(corpus):
    got = mixing.mix_plan(corpus).join(
        corpus.select("doc_id", "source").distinct(), "doc_id").collect()
    assert mixing.mix_plan(corpus).count() == len(ALL)
    sizes = Counter()
    for r in ALL:
        sizes[r[3]] += len([w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w])
    goal = plain_targets(sizes)
    plan = mixing.mix_plan(corpus).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in plan)
    by_size = {v: goal[s] for s, v in sizes.items()}
    for r in plan:
        assert r["target"] == pytest.approx(by_size[r["source_size"]])
    taken = Counter()
    for r in got:
        if r["doc_id"] not in (7, None):
            taken[r["source"]] += r["taken"]
    again = mixing.mix_plan(corpus.repartition(2)).collect()
    assert as_counter(again) == as_counter(plan)


def test_the_mix_is_what_the_plan_says(corpus):
    mixed = mixing.mix(corpus)
    assert mixed.columns == corpus.columns
    words = F.size(mixing.words_of(F.col("text")))
    per = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(words)).collect()}
    sizes = Counter()
    for r in ALL:
        sizes[r[3]] += len([w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w])
    for source, goal in plain_targets(sizes).items():
        assert abs(per.get(source, 0) - goal) <= 2, source


def test_empty_tables(empty):
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert quality.with_verdict(empty).count() == 0
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
