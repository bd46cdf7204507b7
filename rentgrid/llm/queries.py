"""The registered queries ``opN_*`` and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from rentgrid.llm import (
    alignment,
    bpe,
    dedup_stream,
    line_dedup,
    mixing,
    parity_join,
    quality,
    quality_rules,
    suffix_dedup,
    toxicity,
    url_rules,
    whitening,
    wrapper,
)
from rentgrid.llm.tables import read

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle SQL if any."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


@query()
def op1_mix_sources(spark, sf_dir):
    """Every document with its source's target and the words the mix takes."""
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


#: The rank file that op2 and the pipeline encode with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query()
def op2_bpe_round_trip(spark, sf_dir):
    """Every document encoded and decoded."""
    return bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"),
                          public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query()
def op3_html_text(spark, sf_dir):
    """Main text of every page."""
    return wrapper.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query()
def op4_line_dedup(spark, sf_dir):
    """Every document with its near-duplicate lines and what is left of it."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op5_quality(spark, sf_dir):
    """Every document with its quality score."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))


@query()
def op6_toxicity(spark, sf_dir):
    """Every document with its toxicity score."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


@query()
def op7_suffix_dedup(spark, sf_dir):
    """Every document with what is left of it without repeated strings."""
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)""")
def op8_exact_dedup(spark, sf_dir):
    """Every document with its class of equal texts."""
    return dedup_stream.exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


@query()
def op9_quality_rules(spark, sf_dir):
    """Every document with its counts and the verdict of the rules."""
    return quality_rules.rules(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query()
def op10_jaccard_groups(spark, sf_dir):
    """Every document with the smallest id of its group of near-duplicates."""
    return parity_join.similar_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op11_whiten_embeddings(spark, sf_dir):
    """Every usable vector whitened along the leading components."""
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


#: The two vocabularies that op12 aligns.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@query()
def op12_align_tokenizers(spark, sf_dir):
    """Every document with the groups and links of its two tokenisations."""
    return alignment.cross_align(read(spark, sf_dir, "documents", "doc_id", "text"), *map(public_tokenizers.path, ALIGNED))


#: Rules that are reported by name (host and path), and block lists of the library's own.
LISTED_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCKED = ("||ads-track.", "||casino-win.", "||cheap-pills.", "||free-bets.", "||spam-farm.", "||adserver*.", "/affiliate/",
           "/popunder/", "/doubleclick^")


@query(r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     d AS (SELECT *, '.' || host AS sub, host || substr(rest, length(host) + 1) AS address FROM h),
     r AS (SELECT *, CASE WHEN ends_with(sub, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                          WHEN ends_with(sub, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                          WHEN ends_with(sub, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                          WHEN ends_with(sub, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM d)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(address, '^([^/?#]*\.)?(ads-track|casino-win|cheap-pills|free-bets|spam-farm|adserver(?s:.*))\.')
              OR regexp_matches(address, '/affiliate/|/popunder/|/doubleclick([^a-zA-Z0-9_.%-]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r""")
def op13_url_verdicts(spark, sf_dir):
    """Every page with the rule that decides on its url, and the verdict."""
    listed = [("||" + name, verdict, 1) for name, verdict in LISTED_RULES.items()] + [(p, "block", 0) for p in BLOCKED]
    judged = url_rules.judge(read(spark, sf_dir, "pages", "page_id", "url"), url_rules.rules(spark, listed))
    rule = F.when(F.col("rank") == 1, F.substring("pattern", 3, 1 << 20))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")
