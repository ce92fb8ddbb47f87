"""One named query per operator, over its whole table, and DuckDB texts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import alignment, ann, backoff_lm, bpe, decontaminate, licenses, merkle, resample, secrets, sharding, simhash, token_counts, toxicity
from lotwise.llm.vocabulary import ByteVocabulary
from lotwise.sources.tables import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    automaton = token_counts.Automaton.of_byte_vocabulary(ByteVocabulary.read(tokenizer_path("byte_bpe_50k.json")))
    return token_counts.token_counts(table(spark, folder, "documents"), automaton)


@query
def op2_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), "id % 50 = 0", k=5)


@query
def op3_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.scored(table(spark, folder, "documents"))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root").alias("component_id"))


# The chain over the table's own labels; the last category is the one that decides.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, folder, "labels"), CATEGORIES)
    found = toxicity.scored(docs, chain, ["p_poor", "p_toxic"])
    return found.select("doc_id", "p_poor", "p_toxic", (F.col("p_toxic") >= chain.threshold).alias("toxic"))


@query
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"), [1.0] * 16, [1.0] * 17)


@query
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.trained(docs))
    hits = F.filter("candidates", lambda c: c["secret"])
    return found.select(
        "doc_id",
        F.size("candidates").alias("n_candidates"),
        F.size(hits).alias("n_secrets"),
        F.array_join(F.transform(hits, lambda c: F.concat_ws("+", c["start"], c["length"])), ",").alias("spans"),
        F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"),
    )


@query
def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op9_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Draws as large a part of the documents as is good among the labelled ones."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    good = labels.where("quality = 1").select("doc_id")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0] or 0.0
    scores = resample.weighted(docs, resample.fit(docs, good))
    return resample.resampled(scores, round(share * docs.count()))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return merkle.manifest(docs, tampered=merkle.tampered_fifth("doc_id", "text"))


def _field(column: str) -> str:
    return f"case when {column} is null then '-' else concat(strlen(cast({column} as varchar)), ':', {column}) end"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + "))"


_LOWERED = f"translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}')"
# The reflected polynomial of CRC-32, bit by bit over the bytes of the decimal doc_id.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''),
      lambda c: ascii(c)::bigint)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""


def _tree(name: str, nodes: str) -> str:
    """Levels, siblings and paths of the trees of ``nodes`` (tree, pos, n, hash)."""
    return f"""{name}_levels as (select tree, 0 as level, pos, n, hash from {nodes}
    union all select tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' order by pos))
      from {name}_levels where n > 1 group by tree, level, pos // 16, n),
  {name}_sides as (select tree, level, pos, concat(coalesce(string_agg(hash, '') over before, ''), '|',
      coalesce(string_agg(hash, '') over behind, '')) as side from {name}_levels where n > 1
    window before as (partition by tree, level, pos // 16 order by pos rows between unbounded preceding and 1 preceding),
      behind as (partition by tree, level, pos // 16 order by pos rows between 1 following and unbounded following)),
  {name}_roots as (select tree, hash from {name}_levels where n = 1),
  {name}_paths as (select l.tree, l.pos, list(s.side order by s.level) filter (s.side is not null) as sides from {nodes} l
    left join {name}_sides s on l.tree = s.tree and s.pos = l.pos // cast(pow(16, s.level) as bigint) group by l.tree, l.pos)"""


ORACLES["op11_merkle"] = f"""with recursive marked as (select doc_id, case when source is null then '-' else '=' || source end as tree,
    {_leaf('text')} as hash, case when doc_id is not null and {_CRC} % 5 = 0 then {_leaf(_LOWERED)} end as changed from documents),
  leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, hash) - 1 as pos,
    count(*) over (partition by tree) as n from marked),
  {_tree("inner", "leaves")},
  members as (select 'whole' as tree, tree as member, hash, row_number() over (order by tree) - 1 as pos, count(*) over () as n
    from inner_roots),
  {_tree("outer", "members")},
  whole as (select l.doc_id, l.hash as leaf, coalesce(l.changed, l.hash) as own, m.hash as subroot, r.hash as root,
      list_concat(coalesce(p.sides, []), coalesce(t.sides, [])) as sides
    from leaves l join inner_paths p on l.tree = p.tree and l.pos = p.pos join members m on m.member = l.tree
    join outer_paths t on t.pos = m.pos join outer_roots r on r.tree = m.tree),
  folds as (select *, list_reduce(list_prepend(own, sides),
      lambda a, s: sha256(concat(split_part(s, '|', 1), a, split_part(s, '|', 2)))) as folded_root from whole)
  select doc_id, leaf, subroot, root, sha256(replace(array_to_string(sides, ''), '|', '')) as proof_sha256, folded_root,
    folded_root = root as verified from folds"""


@query
def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(table(spark, folder, "documents"))


def _template_rows() -> str:
    """(template, at, gram, length, own, label, base), as the operator's own table has them."""
    rows = []
    for number, t in enumerate(licenses.TEMPLATES):
        words = t.words
        own = min(licenses.K, len(words))
        rows += [
            f"({number}, {i}, '{' '.join(words[i : i + own])}', {len(words)}, {own}, '{t.label}', {t.base})"
            for i in range(len(words) - own + 1)
        ]
    return ", ".join(rows)


_LICENSE_WORDS = f"list_filter(string_split_regex(coalesce({_LOWERED}, ''), '{licenses.GAPS}'), lambda w: w <> '')"
ORACLES["op12_licenses"] = f"""with places(template, place, gram, length, own, label, base) as (values {_template_rows()}),
  docs as (select row_number() over () as id, doc_id, {_LICENSE_WORDS} as words from documents),
  starts as (select id, words, unnest(range(len(words))) as start from docs),
  sizes as (select distinct own from places),
  grams as (select id, start, own, array_to_string(words[start + 1 : start + own], ' ') as gram from starts, sizes
    where start + own <= len(words)),
  diagonals as (select id, template, label, base, length, p.own, start - place as diagonal, list(distinct place) as places
    from grams g join places p on g.gram = p.gram and g.own = p.own group by all),
  firsts as (select *, case when base or diagonal - lag(diagonal) over (partition by id, template order by diagonal) <= {licenses.NEAR}
      and not base then 0 else 1 end as first from diagonals),
  numbered as (select *, sum(first) over (partition by id, template order by diagonal) as span from firsts),
  merged as (select id, template, label, base, length, own, span, list_distinct(flatten(list(places))) as places,
      max(len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + own)))))) as alone,
      min(diagonal + list_min(places)) as start, max(diagonal + list_max(places) + own) as stop
    from numbered group by id, template, label, base, length, own, span),
  shares as (select *, greatest(alone, case when stop - start <= length * {licenses.LOOSE} then
      len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + own))))) else 0 end) / length::double as share from merged),
  verified as (select *, share >= case when base then 1.0 else {licenses.SHARE} end as verified from shares),
  found as (select id, count_if(base and verified) as n_base, min(start) filter (base and verified) as first_word,
      max(start) filter (base and verified) as last_word, string_agg(distinct label, ',' order by label) filter (base and verified) as base_labels,
      string_agg(distinct label, ',' order by label) filter (verified) as labels, max(share) as score from verified group by id)
  select doc_id, len(words) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
    coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
  from docs left join found using (id)"""


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary, pieces = ByteVocabulary.read(tokenizer_path("byte_bpe_50k.json")), alignment.Pieces.read(tokenizer_path("piece_bpe_32k.model"))
    return alignment.alignment(table(spark, folder, "documents"), vocabulary, pieces)
