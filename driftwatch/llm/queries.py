"""The queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import bpe, centroids, classifier, line_dedup, licenses, packing, pages, records, rules, secret_scan, simhash, spelling, transport
from driftwatch.llm.labels import held_out
from driftwatch.llm.tokens import default_vocabulary
from driftwatch.session import bound_batches, fresh_path, table

#: Scores from here on are predicted as label 1.
GOOD = 0.3


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "licenses", "sentence_ids", "n_known")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, default_vocabulary()[0])
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = transport.read(transport.store(docs))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return done.select(
        "doc_id", n_bytes, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access", "error"
    )


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, vocabulary = fresh_path(spark, "token-records"), default_vocabulary()
    records.write_records(docs, path, *vocabulary)
    return records.with_starts(records.write_index(spark, path, *vocabulary)).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *default_vocabulary())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest, cut = rules.fit(docs, table(spark, sf_dir, "labels"))
    done = rules.apply_rules(docs, forest, cut)
    return done.select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = classifier.fit(docs, table(spark, sf_dir, "labels"))
    done = classifier.score(docs, trees)
    predicted = (F.col("score") >= GOOD).cast("int").alias("predicted")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    done = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = [rule.kind for rule in secret_scan.BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    number = [count(kind).alias(f"n_{kind}") for kind in own]
    base = F.filter("spans", lambda x: x["kind"].isin(own))
    return done.select("doc_id", *number, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    done = spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict:
    """The queries by name."""
    return {
        f.__name__: f
        for f in (
            op1_license_scan, op2_line_dedup, op3_bpe, op4_transport_stream, op5_page_text,
            op6_token_records, op7_packing, op8_quality_rules, op9_simhash, op10_quality_classifier,
            op11_secret_scan, op12_centroids, op13_spelling_variants,
        )
    }


def _license_sql() -> str:
    """Cuts at line ends too, and knows the sentences without a break inside: it agrees where notices aren't wrapped, as in the given tables."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(name)})" for s, (name, *parts) in licenses.known_sentences().items() if len(parts) == 1 and licenses.SEEN not in s)
    rules: dict[str, list[str]] = {}
    for name, ids, _ in licenses.RULES:
        rules.setdefault(name, []).append(f"regexp_matches(seq, {quote(licenses.rule_pattern(ids))})")
    beside = {name: others for name, _, others in licenses.RULES}
    one = lambda name: f"({' OR '.join(rules[name])})"
    cases = ", ".join(f"CASE WHEN {' AND NOT '.join([one(name), *map(one, beside[name])])} THEN {quote(name)} END" for name in rules)
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
numbered AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),
cut AS (
  SELECT rn, string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '([.!?;])[ \t\r\f\x0B]+', '\1' || chr(10), 'g'),
    '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS s
  FROM numbered),
each AS (SELECT rn, trim(unnest(s), ' ') AS sentence, generate_subscripts(s, 1) AS i FROM cut),
seen AS (SELECT rn, string_agg(coalesce(',' || name || ',', '') || ';', '' ORDER BY i) AS seq, coalesce(string_agg(name, ',' ORDER BY i), '') AS ids, count(name) AS n
  FROM each LEFT JOIN known USING (sentence) GROUP BY rn),
found AS (SELECT n.doc_id, s.seq, s.ids AS sentence_ids, s.n::BIGINT AS n_known FROM numbered n JOIN seen s USING (rn))
SELECT doc_id, CASE WHEN n_known = 0 THEN '' ELSE array_to_string(list_filter(list_value({cases}), lambda x: x IS NOT NULL), ',') END AS licenses, sentence_ids, n_known FROM found
"""


LINE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rn, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{licenses.UPPER}', '{licenses.LOWER}') AS k
  FROM (SELECT rn, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
owner AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 AND doc_id IS NOT NULL GROUP BY k),
marked AS (
  SELECT l.rn, l.doc_id, l.line, l.i, coalesce(o.first < l.doc_id, false) AS dropped
  FROM lines l LEFT JOIN owner o ON l.k = o.k AND length(l.k) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rn
"""


def _secret_sql() -> str:
    """Matches by DuckDB's own expressions; places are the lengths of what is between and of the matches before."""
    words = "(?i:password|passwd|secret|token|api_?key)"
    base = [
        ("assign", rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(w, pattern, 2)) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(w) >= 16"),
        ("hex", "[0-9a-f]+", "length(w) >= 32"),
    ]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    every = base + [(rule.kind, rule.pattern, f"length(w) >= {rule.least}") for rule in secret_scan.FURTHER]
    parts = [
        f"SELECT rn, {i} AS o, {quote(kind)} AS kind, regexp_extract_all(text, {quote(p)}) AS m, string_split_regex(text, {quote(p)}) AS between, {quote(p)} AS pattern FROM docs"
        for i, (kind, p, _) in enumerate(every)
    ]
    keep = " ".join(f"WHEN {i} THEN {test.replace('pattern', quote(p))}" for i, (_, p, test) in enumerate(every))
    spans = "string_agg(kind || ':' || start || ':' || (start + length(w)), ',' ORDER BY start, o)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT rn, o, kind, w, length(b) AS gap, i FROM
  (SELECT rn, o, kind, unnest(m) AS w, unnest(between[:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0)),
placed AS (SELECT *, CAST(sum(gap + length(w)) OVER (PARTITION BY rn, o ORDER BY i) AS BIGINT) - length(w) AS start FROM each),
kept AS (SELECT * FROM placed WHERE CASE o {keep} END),
seen AS (SELECT rn, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  {spans} FILTER (o < 3) AS base, {spans} AS spans FROM kept GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN seen USING (rn)
"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """The same rounds as common tables, one after the other."""
    nearest = lambda c: f"""SELECT vec_id, x, no, d FROM (SELECT v.vec_id, v.x, c.no,
  list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {c} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, no) = 1"""  # noqa: E731
    steps = ""
    for i in range(rounds):
        steps += f"""a{i} AS MATERIALIZED ({nearest(f"c{i}")}),
s{i} AS (SELECT no, dim, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT no, unnest(x) AS e, generate_subscripts(x, 1) AS dim FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT no, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS m FROM s{i} GROUP BY no),
c{i + 1} AS MATERIALIZED (SELECT c.no, coalesce(m, c) AS c FROM c{i} c LEFT JOIN m{i} USING (no)),
"""
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS no, x AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}),
{steps}a AS ({nearest(f"c{rounds}")}),
i AS (SELECT no, sum(d)::BIGINT AS cluster_inertia FROM a GROUP BY no)
SELECT vec_id, a.no::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN i USING (no) JOIN c{rounds} c USING (no)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return {"op1_license_scan": _license_sql(), "op2_line_dedup": LINE_SQL, "op11_secret_scan": _secret_sql(), "op12_centroids": _centroid_sql()}
