"""Text operators on small rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from loanloom.llm import byte_bpe, decontaminate, language_id, license_scan, line_dedup, near_dedup, personal_data, quality_rules, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", n_lines string, score string, ids string, id long, band long, row long"
rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs(spark, rows, extra=True):
    full = [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]
    if extra:
        return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3) for r in full], SCHEMA + EXTRA)
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd():
    base = prose(60)
    near = base.replace(base.split()[30], "changed", 1)
    line = "a line that is long enough"
    rows = [(1, base, "en", "s"), (2, base, "en", "s"), (3, near, "en", None), (4, None, None, None), (5, "", "fr", "s"), (6, " \n\t ", "en", "s")]
    rows += [(7, f"{line}\nown line of seven\n  {line.upper()} ", "en", "s"), (8, f"{line}\n\nshort", "en", "s"), (8, f"{line}\n\nshort", "en", "s"), (None, f"{line}\nx", "en", "s")]
    return rows + [(9, prose(30_000), "en", "s"), (10, "ÀÉ é 漢字 😀 <|endoftext|> don't", "en", "s")]


def test_near_duplicates(spark, odd):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, odd), 3, 85).collect()}
    by = {k[0]: v for k, v in got.items()}
    assert by[1] == (1, True) and by[2] == (1, False) and by[3] == (1, False)
    assert by[4] == (4, True) and by[5] == (5, True) and by[6] == (6, True) and by[None] == (None, True)
    assert near_dedup.near_duplicates(docs(spark, odd).where("false")).count() == 0
    kept = near_dedup.one_of_each(docs(spark, odd), 3, 85)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert kept.columns == docs(spark, odd).columns


def test_near_duplicates_in_large_groups(spark):
    """Copies with more and more changes: links and components as by brute force."""
    base = prose(120).split()
    rows = []
    for k in range(70):
        words = list(base)
        for at in rnd.sample(range(len(words)), k % 9):
            words[at] = rnd.choice(["foo", "bar", "baz"])
        rows.append((k, " ".join(words), "en", "s"))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == {k: top(k) for k in range(len(rows))}


def test_line_dedup(spark, odd):
    found = line_dedup.without_repeats(docs(spark, odd)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(odd) and "n_lines_" in by[1].asDict() and by[1]["n_lines"] == "x"
    assert (by[7]["n_lines_"], by[7]["n_dropped"]) == (3, 0)
    assert (by[8]["n_lines_"], by[8]["n_dropped"], by[8]["text"]) == (3, 1, "\nshort")
    assert by[None]["n_dropped"] == 0 and by[4]["text"] is None and by[4]["n_lines_"] == 1
    assert by[2]["text"] == "" and by[2]["n_dropped"] == 1 and by[1]["n_dropped"] == 0
    assert line_dedup.without_repeats(docs(spark, odd).where("false")).count() == 0


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    assert sorted(line_dedup.MinimalPerfectHash.build(keys)(keys)) == list(range(len(keys)))


def test_bpe_as_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe.vocabulary_path())
    for r in byte_bpe.decode(byte_bpe.encode(docs(spark, odd))).collect():
        text = next(t for i, t, _, _ in odd if i == r["doc_id"]) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["text"] == library.decode(ids, skip_special_tokens=False)
    bpe = byte_bpe.Bpe.load(byte_bpe.vocabulary_path())
    for text in ("ab" * 3000, "é" * 500, " " * 700):  # the heap gives what the scan gives
        assert bpe.long(text.encode()) == bpe.short(text.encode())


def test_token_counts_by_brute_force(spark, odd):
    scores = token_counts.piece_scores(token_counts.vocabulary_path())
    trie = token_counts.UnigramTrie(scores, nodes=2000)
    for word in [w for _, t, _, _ in odd if t for w in trie.words(t)][:3000]:
        raw, best = word.encode(), [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            best.append(max((best[s][0] + scores[raw[s:end]], best[s][1] - 1) for s in range(end) if raw[s:end] in scores))
        assert trie[word] == -best[-1][1]
    by = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(docs(spark, odd)).collect()}
    assert by[4] == 0 and by[5] == 0 and by[1] == by[2] > 60


def test_decontamination(spark, odd):
    passage = prose(40)
    words = passage.split()
    changed = [("zzz" if k % 6 == 5 else w) for k, w in enumerate(words)]
    rows = [*odd, (20, f"{prose(50)} {passage.upper()}! {prose(10)}", "en", "s"), (21, prose(9) + " " + " ".join(changed), "en", "s"), (22, " ".join(words[:5]), "en", "s")]
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert got[20, 1] == 40 and set(got) == {(20, 1), (21, 1)}
    kept = decontaminate.without_benchmark(docs(spark, rows), bench)
    assert kept.count() == len(rows) - 2 and kept.columns == docs(spark, rows).columns
    assert decontaminate.overlaps(docs(spark, rows), bench.where("false")).count() == 0


def test_personal_data():
    text = "Mail a.b@c-d.org, call +1 (375) 555-4393; card 4207 0512 7910 8084 or 4111111111111111, host 10.0.0.256 and 10.0.0.1."
    spans = personal_data.base_spans(text)
    assert [(personal_data.KINDS[k], text[a:b]) for a, b, k in spans] == [("email", "a.b@c-d.org"), ("phone", "+1 (375) 555-4393"), *([("card", "4207 0512 7910 8084")] if personal_data.luhn("4207051279108084") else []), ("card", "4111111111111111"), ("ip", "10.0.0.1")]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_patterns_by_brute_force():
    for _ in range(3000):
        text = "".join(rnd.choice("a1.@-+ 25") for _ in range(rnd.randint(0, 30)))
        got = personal_data.base_spans(text)
        assert [s[:2] for s in got if s[2] == 0] == [m.span() for m in EMAIL.finditer(text)]
        assert [s[:2] for s in got if s[2] == 1] == [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_repeated_token_gets_its_label(spark):
    known = "write to jo.doe@mail.example now. later jo.doe@mail (at home) " + prose(20)
    field = personal_data.fit([f"mail x{k}.y@mail{k}.example.com and {prose(5)} call 12{k}" for k in range(50)])
    rows = [(1, known, "en", "s"), (2, prose(20), "en", "s"), (3, None, None, None), (4, "", None, None)]
    got = {r["doc_id"]: r for r in personal_data.find(docs(spark, rows), field).collect()}
    assert got[1]["base"] == f"email:9:{9 + len('jo.doe@mail.example')}" and got[1]["spans"].startswith(got[1]["base"])
    assert got[1]["spans"].count("email") == 2
    assert got[2]["spans"] == got[3]["spans"] == got[4]["base"] == ""


def test_quality_rules(spark, odd):
    menu = "home about contact and many other words of this menu line"
    rows = [*odd, *((100 + k, f"{menu}\n{prose(40) if k else ''}", "en", "h") for k in range(8))]
    got = {r["doc_id"]: r for r in quality_rules.judged(docs(spark, rows), limit_docs=5).collect()}
    assert got[101]["n_removed_lines"] == 1 and got[101]["kept"] and not got[100]["kept"]
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and got[6]["n_words"] == 0
    repeated = docs(spark, [(1, " ".join([*"abcdefghij"] * 3), "en", "s")])
    assert quality_rules.judged(repeated).first()["n_repeat_words"] == 30
    assert quality_rules.judged(docs(spark, odd).where("false")).count() == 0


def test_quality_rules_with_production_limits(spark):
    """A line in 5 documents or more goes if these are over 2 % of the host or over 1,000; at a limit it stays."""
    line = "follow us on all of these pages for more"
    rows = [(k, f"{prose(30)}\n{line}" if k < 5 else prose(30), "en", "small") for k in range(20)]
    rows += [(100 + k, f"{prose(30)}\n{line}" if k < 4 else prose(30), "en", "four") for k in range(20)]
    rows += [(1000 + k, f"{prose(25)}\n{line}" if k < 6 else prose(25), "en", "share") for k in range(300)]  # 6 are 2 % and no more
    rows += [(200 + k, "\n".join([prose(3), line, line]), "en", "thin") for k in range(6)]
    got = {r["doc_id"]: r for r in quality_rules.judged(docs(spark, rows)).collect()}
    assert all(got[k]["n_removed_lines"] == (k < 5) and got[k]["kept"] for k in range(20))
    assert all(got[k]["n_removed_lines"] == 0 for k in [*range(100, 120), *range(1000, 1300)])
    assert all(got[k]["n_removed_lines"] == 2 and not got[k]["kept"] for k in range(200, 206))
    assert quality_rules.frequent_lines(docs(spark, rows), limit_docs=5, limit_share=1.0).count() == 2


def test_licenses(spark):
    mit = license_scan.TEXTS["MIT"][0]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.replace("sublicense", "sublicence").upper(), "en", "s"), (2, "text\nlicensed under the apache licence version 2.0", "en", "s"), (3, None, None, None), (4, "", None, None), (5, mit + " and more", "en", "s")]
    got = {(r["doc_id"], r["unit"], r["position"], r["license"]) for r in license_scan.scan(docs(spark, rows), license_scan.known_texts(spark)).collect()}
    assert got == {(1, "document", 0, "MIT"), (2, "line", 1, "Apache-2.0")}


def test_language_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    net = language_id.train(table)
    got = language_id.predict(table, net).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    odd_rows = docs(spark, [(1, None, None, None), (2, "123 !", "en", "s"), (3, "", "en", "s")])
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(odd_rows, net).collect()} == {("und", 0.0)}
    assert language_id.train(odd_rows.where("false")) is None and language_id.predict(odd_rows, None).count() == 3
    model = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [(1, "you idiot. fine day", "en", "s"), (2, "the of and.", "en", "s"), (3, None, None, None), (4, "", None, None)]), model).collect()}
    assert scores[1] > scores[2] and scores[3] == scores[4] == 0.0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() <= 200
    rows = out.collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    # no copy is left, and no text that holds a benchmark item word by word
    coded = [bytes(r["ids"]) for r in rows if r["n_tokens"]]
    assert len(set(coded)) == len(coded)
    bpe = byte_bpe.Bpe.load(byte_bpe.vocabulary_path())
    texts = [" ".join(re.findall(r"\w+", bpe.decode(x).lower())) for x in coded]
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert not any(item in text for item in items if len(item.split()) >= 10 for text in texts)


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    table = docs(spark, []).drop("n_lines", "score", "ids", "id", "band", "row")
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "/root/testdata/sf0.001")
    assert table.columns == ["doc_id", "n_tokens", "ids"] and table.count() == 0


def test_components_of_chains(spark):
    from loanloom.llm import near_dedup

    def found(labels):
        return sorted((r["id"], r["component"]) for r in labels.collect())

    chain = spark.createDataFrame([(5, 4), (3, 4), (2, 3), (2, 1), (8, 9), (9, 8)], "a long, b long")
    labels = near_dedup.joined_components(None, chain)
    assert found(labels) == [(2, 1), (3, 1), (4, 1), (5, 1), (9, 8)]
    more = spark.createDataFrame([(9, 5), (11, 10)], "a long, b long")
    assert found(near_dedup.joined_components(labels, more)) == [(2, 1), (3, 1), (4, 1), (5, 1), (8, 1), (9, 1), (11, 10)]
    assert found(near_dedup.components(chain.limit(0))) == []
