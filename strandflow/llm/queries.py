"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(n: int, remainder: int):
    """Whether crc32 of the doc_id modulo n is the remainder; a row without a doc_id is not held out (it teaches nothing either)."""
    from .labelled import key_mod

    return F.coalesce(key_mod("doc_id", n) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import key_mod
    from .langid import detect, learn

    docs = read_table(spark, sf_dir, "documents")
    found = detect(docs, learn(docs.where(key_mod("doc_id", 4) != 2)))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes; the digests are of the operator's ids and bytes."""
    from .bpe import decode, encode

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    back = decode(encode(read_table(spark, sf_dir, "documents"), path), path)
    written_out = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written_out.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, judged

    docs = read_table(spark, sf_dir, "documents")
    found = judged(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


#: The rules that op5 judges by.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
with recursive
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p as (select page_id, url, coalesce(html, '') html, row_number() over () n,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1), '') query from pages),
g as (select n, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s(?:[^<>"'']|"[^"]*"|''[^'']*'')*>')) tag, generate_subscripts(regexp_extract_all(html, '(?is)<(?:link|meta)\s(?:[^<>"'']|"[^"]*"|''[^'']*'')*>'), 1) place from p),
x as (select n, tag, place, unnest(regexp_extract_all(tag, '(?is)[^\s=>"''/]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')) attr,
      generate_subscripts(regexp_extract_all(tag, '(?is)[^\s=>"''/]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), 1) spot from g),
y as (select n, place, lower(regexp_extract(attr, '^[^\s=]+')) name, spot, regexp_extract(attr, '(?s)^[^=]*=\s*(.*)$', 1) raw from x),
z as (select n, place, name, spot, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(case when raw[1] in ('"', chr(39)) then raw[2:-2] else raw end,
      '(?i)&quot;|&#34;|&#x22;', '"', 'g'), '(?i)&#39;|&#x27;|&apos;', chr(39), 'g'), '(?i)&lt;|&#60;|&#x3c;', '<', 'g'), '(?i)&gt;|&#62;|&#x3e;', '>', 'g'), '(?i)&#47;|&#x2f;', '/', 'g'), '(?i)&#38;|&#x26;|&amp;', '&', 'g')) value from y),
tags as (select n, place, arg_min(value, spot) filter (name = 'rel') rel, arg_min(value, spot) filter (name = 'href') href, arg_min(value, spot) filter (name = 'http-equiv') equiv, arg_min(value, spot) filter (name = 'content') content from z group by n, place),
kinds as (select tags.n, tags.place, lower(g.tag[2:5]) kind, rel, href, equiv, regexp_extract(content, '(?is)\burl\s*=\s*["'']?\s*([^"''\s]+)', 1) url from tags join g on g.n = tags.n and g.place = tags.place),
named as (select n, arg_min(href, place) link from kinds where kind = 'link' and list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') and href is not null group by n
          union all select n, arg_min(url, place) from kinds where kind = 'meta' and lower(equiv) = 'refresh' and url <> '' group by n),
t as (select host || path || query a, case when link like '#%' then null when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
        when link like '//%' then 'x:' || link when host = '' then null when link like '/%' then 'x://' || host || link when link like '?%' then 'x://' || host || path || link
        else 'x://' || host || case when path like '%/%' then regexp_extract(path, '^(.*/)', 1) else '/' end || link end target
      from named join p using (n) where link <> '' and host <> ''),
dots(a, host, path, query) as (
      select a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1), regexp_extract(target, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) from t where target is not null
      union all select a, host, case when regexp_matches(path, '/\.(/|$)') then regexp_replace(path, '/\.(/|$)', '/') when regexp_matches(path, '^/\.\.(/|$)') then regexp_replace(path, '^/\.\.(/|$)', '/') else regexp_replace(path, '/[^/]*/\.\.(/|$)', '/') end, query
      from dots where regexp_matches(path, '/\.\.?(/|$)')),
u as (select a, host, path, query from dots where not regexp_matches(path, '/\.\.?(/|$)')),
e as (select a, host || path || query b from u where host <> ''),
s as (select a, b from e union select b, a from e),
r(a, b) as (select a, a from s union select r.a, s.b from r join s on s.a = r.b),
n as (select distinct a, regexp_extract(a, '^([^/?#]*)', 1) host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) path from s),
nv as (select a, arg_max(verdict, length(rhost || rpath)) verdict from n join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by a),
carried as (select r.a from r join nv on nv.a = r.b group by r.a having bool_or(verdict = 'block') and not bool_or(verdict = 'allow')),
own as (select page_id, host, path, host || path || query address, arg_max(rhost || rpath, length(rhost || rpath)) rule, arg_max(verdict, length(rhost || rpath)) verdict
        from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
        group by n, page_id, host, path, query)
select page_id, host, path, rule, case when verdict is not null then verdict when host <> '' and address in (select a from carried) then 'block' else 'allow' end verdict from own
"""


#: Pages whose canonical link leads to the first of each LINKED page ids in a row.
LINKED = 7


def url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 on pages with canonical links made from their ids: so that decisions are carried over in components."""
    from .url_filter import judged

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first = pages.select((F.col("page_id") / LINKED).cast("long").alias("run"), F.col("url").alias("to")).where(F.col("page_id") % LINKED == 0)
    linked = pages.withColumn("run", (F.col("page_id") / LINKED).cast("long")).join(first, "run", "left")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<link rel="canonical" href="'), F.coalesce("to", F.lit("")), F.lit('">'))
    return judged(linked.select("page_id", "url", html.alias("html")), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


LINKS_SQL = OP5_SQL.replace(
    "rules(verdict",
    f"""linked as (select p.page_id, p.url, coalesce(p.html, '') || '<link rel="canonical" href="' || coalesce(f.url, '') || '">' html
        from pages p left join pages f on f.page_id % {LINKED} = 0 and f.page_id // {LINKED} = p.page_id // {LINKED}),
rules(verdict""",
    1,
).replace("from pages),", "from linked),", 1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the operator's spans."""
    from .secret_scan import BASE_KINDS, scan, written_out

    spans = F.col("spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    base = written_out(of(*BASE_KINDS))
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written_out(spans).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(read_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is of the operator's groups as text."""
    from .token_alignment import aligned, piece_count, with_link_scores

    a_path, b_path = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    groups = aligned(read_table(spark, sf_dir, "documents"), a_path, b_path)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    scored = with_link_scores(groups.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", digest), piece_count(b_path))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import key_mod
    from .rule_ensemble import fit, scored

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = scored(docs, fit(docs, labels.where(key_mod("doc_id", 5) != 0)))
    return found.select("doc_id", held_out(5, 0), "score", "predicted")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store

    return read_store(spark, write_store(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_permutation_ann": op2_permutation_ann,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_token_store": op8_token_store,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
    "op11_secret_scan": op11_secret_scan,
    "op12_whitening": op12_whitening,
    "op13_token_alignment": op13_token_alignment,
    "url_links": url_links,
}

ORACLE: dict[str, str] = {"op5_url_filter": OP5_SQL, "url_links": LINKS_SQL}
