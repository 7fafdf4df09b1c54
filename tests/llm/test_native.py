"""URL filters, licence scans and sharding against plain versions and DuckDB."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import license_scan, registry, sharding, url_filter

SF = "/root/testdata/sf0.01"


def same_rows(frame, sql, folder):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        if Path(folder, f"{name}.parquet").exists():
            source = f"{folder}/{name}.parquet" + ("/*.parquet" if Path(folder, f"{name}.parquet").is_dir() else "")
            con.execute(f"create view {name} as select * from '{source}'")
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(frame.columns)
    got = Counter(map(str, map(tuple, frame.select(names).collect())))
    assert got == Counter(map(str, wanted.fetchall()))
    return got


# -- URL filters


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


URLS = [
    "http://example.com/en/7", "http://EXAMPLE.com/en/71?x#y", "https://a.b.example.com/en/8", "x://com/en/", "x://notcom/en/", "x://example.net/de/8/", "x://example.net/de/9",
    "x://net", "no scheme", "", None, "://org/es/", "a://b://org/es/", "x://É.org/es/é", "x://org?/es/", "x://org#/es/", "x://user@a.org:80/es/", "x://a.org/ES/", "x://a..org/es/\nz", "x://.com/en/", "x://com/en",
]


def test_verdicts_match_a_plain_version(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "x://com/en/"), (3, URLS[3]), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("clash"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["op1_url_filter"](spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *plain_verdict(u, registry.URL_RULES))) for i, u in rows)
    same_rows(got, registry.ORACLE_SQL["op1_url_filter"], tmp_path)


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_rules(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 10**6 if broadcast else 0)
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "c", "aa"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choices("ab/", k=rng.randrange(0, 5)))
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice([path(), ""])) for _ in range(80)]
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rules_table(spark, rules), default="block")
    strongest = {}
    for v, h, p in rules:
        strongest[h, p] = max(v, strongest.get((h, p), v))
    rules = [(v, h, p) for (h, p), v in strongest.items()]
    assert sorted(map(tuple, got.collect())) == sorted((i, *plain_verdict(u, rules, "block")) for i, u in enumerate(urls))


def test_no_rules_and_no_pages(spark):
    rules = url_filter.rules_table(spark, [])
    pages = spark.createDataFrame([(1, "x://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).collect()] == [(1, "a", "/b", None, "allow")]
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, registry.URL_RULES)).collect() == []
    with pytest.raises(ValueError):
        url_filter.rules_table(spark, [("block", "", "/")])


# -- licence scans


def test_scan_matches_sql(spark, tmp_path):
    header = license_scan.TEMPLATES[1][1]
    wrapped = header.replace(" ", "\n", 9)
    rows = [
        (1, "Released under the MIT License."), (2, "x\n  released UNDER the mit-license!!\ny"), (3, f"intro\n\n{wrapped}\n \t\nmore"), (4, None), (5, ""), (6, "word"), (7, "\n\n\n"),
        (8, "This work is licensed under the GNU General Public License, version 2 or 3."), (9, "licensed under cc by"), (9, "Licensed under CC BY-NC 4.0."), (9, "Licensed under CC BY-NC 4.0."),
        (None, "Released under the MIT License."), (10, "é " * 5000 + "\nReleased under the MIT License, é."), (11, header + " " + header), (12, "Licensed under CC BY 4.0 Licensed"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("n", F.lit(0))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = same_rows(registry.QUERIES["op4_license_scan"](spark, str(tmp_path)), registry.ORACLE_SQL["op4_license_scan"], tmp_path)
    assert any("'paragraph', 1, 'Apache-2.0'" in row for row in got)
    assert sum(n for row, n in got.items() if row.startswith("(9, ")) == 2


def test_scan_finds_all_notices_of_the_tables(spark):
    found = same_rows(registry.QUERIES["op4_license_scan"](spark, SF), registry.ORACLE_SQL["op4_license_scan"], SF)
    assert len(found) > 10


def plain_scan(rows, threshold=license_scan.THRESHOLD):
    """Every segment against every template, without a bound on sizes."""

    def grams(text):
        ws = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
        return set(zip(ws, ws[1:]))

    known = [(nth, name, g) for nth, (name, text) in enumerate(license_scan.TEMPLATES) if (g := grams(text))]
    for doc_id, text in rows:
        lines = [("line", k, s) for k, s in enumerate((text or "").split("\n"))]
        paragraphs = [("paragraph", k, s) for k, s in enumerate(re.split(r"\n[ \t\r]*\n", text or "")) if "\n" in s.strip("\n \t\r")]
        whole = [("text", 0, text)] if len(re.split(r"\n[ \t\r]*\n", text or "")) > 1 else []
        for kind, position, segment in lines + paragraphs + whole:
            mine = grams(segment)
            dice, before, name = max((2 * len(mine & g) / (len(mine) + len(g)), -nth, name) for nth, name, g in known)
            if dice >= threshold:
                yield doc_id, kind, position, name, -before, dice


def test_scan_finds_segments_that_repeat_words(spark):
    notice, header = "Licensed under CC BY 4.0.", license_scan.TEMPLATES[1][1]
    rows = [
        (1, f"{notice} {notice}"), (2, " ".join([notice] * 200)), (3, f"{header} {header}"), (4, "\n".join(["x", *[notice] * 9])), (5, "Licensed under under CC BY BY 4.0"),
        (6, "a b " * 500 + "Released under the MIT License."), (7, "MIT MIT MIT MIT MIT MIT"), (8, None), (9, ""), (10, notice),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.templates_table(spark))
    wanted = Counter(plain_scan(rows))
    assert {(1, "line", 0), (2, "line", 0), (3, "line", 0), (4, "paragraph", 0)} <= {w[:3] for w in wanted}
    assert Counter(map(tuple, got.collect())) == wanted


def test_scan_of_the_tables_needs_no_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, license_scan.scan(docs, license_scan.templates_table(spark)).collect())) == Counter(plain_scan(map(tuple, docs.collect())))


def test_whole_licences_and_their_paragraphs(spark):
    texts = {name: "\n\n".join(p.replace(", ", ",\n") for p in paragraphs) for name, paragraphs in license_scan.WHOLE}
    prose = "\n".join(f"w{i} x{i * 7}" for i in range(900)) + "\n\n"
    rows = list(enumerate(f"Copyright (c) 2024 someone\n\n{t}" for t in texts.values())) + [(100 + k, prose + t) for k, t in enumerate(texts.values())]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.templates_table(spark)).collect()
    for k, name in enumerate(texts):
        assert [r.license for r in got if r.doc_id == k and r.kind == "text"] == [name]
        own = [r for r in got if r.doc_id == 100 + k and r.kind != "text"]
        assert len(own) >= len(dict(license_scan.WHOLE)[name]) - 1 and not [r for r in got if r.doc_id == 100 + k and r.kind == "text"]
    assert Counter(map(tuple, got)) == Counter(plain_scan(rows))
    assert len({text for _, text in license_scan.TEMPLATES}) == len(license_scan.TEMPLATES)


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty, license_scan.templates_table(spark)).collect() == []
    one = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    assert license_scan.scan(one, license_scan.templates_table(spark, [])).collect() == []
    assert license_scan.scan(one, license_scan.templates_table(spark, [("x", ""), ("y", "one")])).collect() == []


# -- sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    grid = spark.range(1 << dims * bits).select(*[(F.shiftright("id", bits * k) % (1 << bits)).cast("int").alias(f"x{k}") for k in range(dims)])
    rows = sorted(tuple(r) for r in grid.select(sharding.hilbert_index([F.col(f"x{k}") for k in range(dims)], bits).alias("h"), "*").collect())
    assert [r[0] for r in rows] == list(range(1 << dims * bits))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def check_law(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n", [0, 1, 23, 25, 500])
def test_shards_of_awkward_rows(spark, monkeypatch, tmp_path, n):
    monkeypatch.setattr(sharding, "SUBCELL_ROWS", 7)
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2, *range(3, 300)]), rng.choice(["", None, "same", "ü" * 9]), rng.choice(["en", "en", "en", None, ""]), rng.choice(["s", "s", "t", None]), rng.choice([None, 0, 5, 10**9])) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit("clash")).withColumn("cell", F.lit(0))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op5_hilbert_shards"](spark, str(tmp_path)).collect()
    check_law(got, 24)
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == wanted
    assert [r.shard for r in sorted(got, key=lambda r: (r.hilbert, r.shard))] == sorted(r.shard for r in got)


def test_tables_and_files_prune(spark, tmp_path):
    got = registry.QUERIES["op5_hilbert_shards"](spark, SF)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert [t for _, t in got.dtypes][:7] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    check_law(got.collect(), 24)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, "doc_id", ["lang", "n_chars"], 12, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.drop("shard", "slot").exceptAll(docs).count() == 0 == docs.exceptAll(read.select(docs.columns)).count()
    spans = read.groupBy("shard").agg(F.countDistinct("lang").alias("n")).collect()
    assert sum(r.n for r in spans) < 12 * 2.5


def test_a_hot_id_and_long_common_prefixes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUBCELL_ROWS", 50)
    prefix = "a common prefix " * 20
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(7).cast("long").alias("k"), F.concat(F.lit(prefix), F.lpad((F.col("id") % 16).cast("string"), 2, "0")).alias("name"), F.lit(0).alias("rank_of"))
    seen = {}
    monkeypatch.setattr(sharding, "checkpointed", lambda df: seen.setdefault(len(seen), df.checkpoint()))
    got = sharding.hilbert_shards(rows, "k", ["name"], 16).collect()
    check_law(got, 16)
    by = {}
    for r in got:
        by.setdefault(r.shard, set()).add(r.name)
    assert all(len(names) == 1 for names in by.values())  # whole texts part the rows, not their first bytes
    with pytest.raises(ValueError):
        sharding.hilbert_shards(rows, "k", ["name"] * 5, 16)


@pytest.mark.parametrize("seed", range(4))
def test_text_cuts_are_exact_quantiles(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice(["", "a", "a" * 30, "b", "bb", "é", "zz"] + [f"v{i}" for i in range(30 * seed)]) for _ in range(rng.choice([1, 7, 400]))]
    got = sharding.text_cuts(spark.createDataFrame([(v,) for v in values] + [(None,)], "c string").repartition(3), "c", 8)
    ordered = sorted(values, key=lambda v: v.encode())
    wanted = []
    for i in range(1, 9):
        at = ordered[-(-i * len(ordered) // 8) - 1]
        if at not in wanted and at != ordered[-1]:
            wanted.append(at)
    assert got == wanted


def plain_curve(point, bits):
    """The index on the curve by walking it: rotations of a quadrant, or octant, from the coarsest bit."""
    n, x = len(point), list(point)
    for level in range(bits - 1, 0, -1):
        for i in range(n):
            if x[i] >> level & 1:
                x[0] ^= (1 << level) - 1
            else:
                t = (x[0] ^ x[i]) & ((1 << level) - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[n - 1] >> level & 1:
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | x[i] >> b & 1
    return index


def test_query_matches_plain_ranks(spark):
    """Every row's curve index by plain quantiles, and shards that follow it."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "n_chars").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op5_hilbert_shards"](spark, SF).collect()}
    assert len(got) == len(docs)

    def ranges(values):
        values = [(v is not None, v) for v in values]
        ordered, cuts = sorted(v for v in values if v[0]), []
        for i in range(1, 16):
            at = ordered[-(-i * len(ordered) // 16) - 1]
            if at not in cuts:
                cuts.append(at)
        return [sum(v > c for c in cuts) for v in values]

    columns = [ranges([d[k] for d in docs]) for k in (1, 2, 3)]
    for d, *point in zip(docs, *columns):
        assert got[d[0]].hilbert == plain_curve(point, 4)
    counts, before = Counter(r.hilbert for r in got.values()), 0
    first = {}
    for h in sorted(counts):
        first[h], before = before, before + counts[h]
    for r in got.values():
        low, high = (rank * 24 // len(docs) for rank in (first[r.hilbert], first[r.hilbert] + counts[r.hilbert] - 1))
        assert low <= r.shard <= high
