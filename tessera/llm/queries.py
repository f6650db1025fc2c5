"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import brown, embeddings, jaccard, language, packing, piece_bpe, secrets, spotsigs, token_store, warc
from tessera.tables import load


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"), 0.95)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(load(spark, sf_dir, "pages"), 100)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "position", "sound")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2048, 1, with_ids=False)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_pieces(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(load(spark, sf_dir, "documents"), 7, 2)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(load(spark, sf_dir, "documents"), 80, 5)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(load(spark, sf_dir, "documents")))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(load(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fold = language.remainder("doc_id", 4)
    model = language.fit(docs.where(fold != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_warc, op3_packing, op4_sentencepiece, op5_token_files, op6_brown_lm, op7_jaccard_join, op8_secrets, op9_spotsigs, op10_language)}

#: DuckDB has no shorter way to a component than all that is reachable.
REACHED = """reached(id, root) as (select id, id from usable union select l.a, r.root from reached r join links l on l.b = r.id)"""
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES: dict[str, str] = {
    "op1_embedding_neardup": f"""with recursive usable as (
    select vec_id as id, cast(embedding as double[]) as v from embeddings
    where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.id as a, y.id as b from usable x join usable y on x.id <> y.id and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.95),
{REACHED},
least as (select id, min(root) as component_id from reached group by id),
totals as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join least on id = vec_id left join totals on a = vec_id""",
    "op2_warc": """with rows as (
    select page_id, coalesce(html, '') as body, url, octet_length(encode(coalesce(html, ''))) as n from pages),
firsts as (select sha256(body) as digest, min(page_id) as first_id from rows where n >= 100 group by 1),
parts as (
    select rows.*, first_id, 1704067200 + page_id % 1000000000 as captured,
        regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['host', 'path', 'query']) as u
    from rows left join firsts on digest = sha256(body) and n >= 100),
keyed as (
    select *, lower(array_to_string(list_reverse(string_split(regexp_replace(u.host, '^www\\.', ''), '.')), ',') || ')' || (case when u.path = '' then '/' else u.path end) || (case when len(u.query) > 1 then u.query else '' end)) as urlkey from parts)
select page_id, n as payload_bytes, sha256(body) as payload_digest, case when page_id <> first_id then 'revisit' else 'response' end as record_type,
    case when page_id <> first_id then first_id end as refers_to, urlkey, captured, row_number() over (order by urlkey, captured, page_id) - 1 as position, true as sound
from keyed""",
    "op7_jaccard_join": f"""with recursive texts as (select doc_id as id, {WORDS} as w from documents),
shingles as (
    select distinct id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k : k + 4], ' ') end as s
    from (select id, w, unnest(range(1, greatest(2, len(w) - 3))) as k from texts where len(w) > 0)),
usable as (select id, count(*) as n from shingles group by id),
shared as (select x.id as a, y.id as b, count(*) as n from shingles x join shingles y on x.s = y.s and x.id <> y.id group by 1, 2),
links as (select a, b from shared join usable p on p.id = a join usable q on q.id = b where 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
{REACHED},
least as (select id, min(root) as component_id from reached group by id)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id
from documents left join usable u on u.id = doc_id left join least l on l.id = doc_id""",
}
