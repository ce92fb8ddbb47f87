"""Secret scan in SQL functions: candidates by pattern, false positives removed by a random forest.

A candidate is what an announcing word assigns, whatever its length and characters, or a run of at least twelve key
characters with a digit. The forest judges its length, its changes
between character classes, how much of it dictionary words cover, whether it reads like a path, address or host,
and the words beside it. The forest is fitted by Spark's own trainer on labelled findings, at most ``SAMPLE`` of them, and
applied as arrays of nodes that a higher-order function walks: scanning is one projection of the documents, with no
shuffle and no Python.

The dictionary holds the most frequent words of the whole corpus. NULL texts stay NULL and, like empty ones,
have no candidates. Every occurrence is judged by itself; repeated rows are judged alike. Texts are scanned whole.
Without labelled findings of both kinds every candidate counts as a secret.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.corpus import unused, written

SAMPLE = 20_000
TREES, DEPTH = 25, 6
# Words of the dictionary, their least length, and documents that lend words to made-up findings.
DICTIONARY, WORD_LETTERS = 400, 3
MADE_FROM = 1_500
THRESHOLD = 0.5
MASK = "<secret>"
# Characters of context that are looked at on the left.
BESIDE = 40

KEY_CHARACTERS = r"A-Za-z0-9+/_@.\-"
CANDIDATE = rf"(?<![{KEY_CHARACTERS}])(?=[A-Za-z+/_@.\-]*+[0-9])[{KEY_CHARACTERS}]{{12,}}+={{0,2}}"
# Words that announce a secret.
ANNOUNCING = """password passwd pwd passphrase passcode secret token apikey api_key api-key access_key access-key accesskey private_key private-key
    privatekey secret_key secret-key secretkey credential credentials bearer auth authorization""".split()
# What stands before an announced value: the word and its endings, a sign of assignment, and perhaps a scheme and a quote.
_TOLD = "|".join(sorted(ANNOUNCING, key=len, reverse=True))
_ENDINGS = "s?(?:[_-][A-Za-z0-9]{1,16}(?:[_-][A-Za-z0-9]{1,16})?)?"
_SIGN = rf"""(?i:{_TOLD}){_ENDINGS}\\?["'`]?\]?\s{{0,4}}(?:[=:]{{1,2}}>?|>)\s{{0,8}}(?:(?i:bearer|basic|token)\s{{1,2}})?\\?["'`]?"""
# Cheap looks back come first: only few places are behind a sign or a scheme.
_BEHIND = rf"""(?<=[=:>\s"'`])(?<=[=:>][\s\\"'`]{{0,9}}|(?i:bearer|basic|token)\s{{1,3}}["'`]?)(?:(?<={_SIGN})|(?<=\b(?i:bearer)\s{{1,3}}["'`]?))"""
# Not a value: blanks, quotes, marks that end one, a scheme, or another announcing word with its sign.
_STARTS = rf"""(?![\s"'`,;=>)\]}}\\]|(?i:bearer|basic|token)\s|[\w.-]{{0,24}}(?i:{_TOLD}){_ENDINGS}\s{{0,4}}[=:])"""
# Quoted values end at the same quote of the line, others at a blank, quote, tag or the next assignment, without the marks of a sentence.
_QUOTED = "|".join([r"""(?<=\\")[^\r\n]+?(?=\\")""", *[rf"""(?<={q})[^\r\n]+?(?<!(?<!\\)\\)(?={q})""" for q in "\"'`"]])
_PLAIN = r"""[^\s"'`]+?(?=[,;.)\]}]{0,3}(?:[\s"'`]|\z)|</|[,;&?][\w.-]{1,40}[=:])"""
ANNOUNCED = f"{_BEHIND}{_STARTS}(?:{_QUOTED}|{_PLAIN})"
ANY = f"{ANNOUNCED}|{CANDIDATE}"
# Formats that are secrets wherever they stand.
FORMATS = r"""^((AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|[rs]k_(live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{36}|AIza[\w-]{35}|SG[.][\w-]{16,}[.][\w-]{16,}|eyJ[\w-]{8,}[.]eyJ[\w-]+[.][\w-]+)$"""
FEATURES = (
    "length", "class_changes", "digit_share", "upper_share", "hex", "distinct_share", "covered", "path_marks", "address", "dotted_numbers",
    "announced", "assigned", "quoted",
)


def _features(dictionary: list[str]) -> str:
    """SQL of the features of one candidate ``c`` (value, before, after) as an array of doubles."""
    words = "|".join(sorted(map(re.escape, dictionary), key=lambda w: (-len(w), w))) or "(?!)"
    told = "|".join(ANNOUNCING)
    classes = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(c.value, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '0'), '[^aA0]+', '-')"
    size = "greatest(length(c.value), 1)"
    share = lambda kind: f"length(regexp_replace(c.value, '[^{kind}]', '')) / {size}"
    parts = [
        "length(c.value)",
        f"(length({classes}) - 1) / {size}",
        share("0-9"),
        share("A-Z"),
        "if(c.value rlike '^([0-9a-f]+|[0-9A-F]+)$', 1, 0)",
        f"size(array_distinct(split(c.value, ''))) / {size}",
        f"1 - length(regexp_replace(lower(c.value), '{words}', '')) / {size}",
        r"length(regexp_replace(c.value, '[^/.\\\\]', ''))",
        "if(c.value like '%@%' or c.after = '@', 1, 0)",
        r"if(c.value rlike '^[0-9]+([.\\-/][0-9]+)+$', 1, 0)",
        rf"if(lower(c.before) rlike '({told})[^a-z0-9]*$', 1, 0)",
        r"if(c.before rlike '[=:]\\s*[\"\']?$', 1, 0)",
        r"if(c.before rlike '[\"\'`]$', 1, 0)",
    ]
    return f"array({', '.join(f'cast({p} as double)' for p in parts)})"


def _listed(matches: str, parts: str) -> str:
    """SQL of the candidates with what stands beside them."""
    # A short stretch is led by the candidates and stretches before it; none of them is empty but a stretch behind a closing "=".
    lead = f"""array_join(transform(slice({matches}, greatest(i - {BESIDE}, 0) + 1, least(i, {BESIDE})),
        (x, k) -> concat(right({parts}[greatest(i - {BESIDE}, 0) + k], {BESIDE}), right(x, {BESIDE}))), '')"""
    before = f"right(if(length({parts}[i]) >= {BESIDE}, {parts}[i], concat({lead}, {parts}[i])), {BESIDE})"
    after = f"left(if({parts}[i + 1] = '', coalesce(get({matches}, i + 1), ''), {parts}[i + 1]), 1)"
    return f"transform({matches}, (m, i) -> struct(m as value, {before} as before, {after} as after))"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, before, after) of every candidate."""
    found = _cut(docs.select(key, text), text, "__matches", "__parts").where("size(__matches) > 0")
    return found.select(key, F.explode(F.expr(_listed("__matches", "__parts"))).alias("c")).select(key, "c.value", "c.before", "c.after")


def _cut(docs: DataFrame, text: str, matches: str, parts: str) -> DataFrame:
    """The candidates of each text and the stretches between them (NULL where there is none)."""
    pattern = F.lit(ANY)
    found = docs.withColumn(matches, F.coalesce(F.regexp_extract_all(text, pattern, F.lit(0)), F.array().cast("array<string>")))
    return found.withColumn(parts, F.when(F.size(matches) > 0, F.split(F.col(text), ANY, -1)))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The words of ``WORD_LETTERS`` letters or more that most documents hold."""
    words = F.array_distinct(F.split(F.lower(text), "[^a-z]+"))
    each = docs.select(F.explode(words).alias("word")).where(F.length("word") >= WORD_LETTERS)
    top = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.collect()]


def labelled_findings(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(value, before, after, label): what is known about candidates, for want of a table of reviewed findings.

    Half are the corpus's own candidates that a rule decides; the others of the corpus stay out, as nothing is known about them.
    The second half is written around hashes of keys: random strings announced as secrets, tokens of known formats, and dictionary
    words, placeholders, paths, versions, numbers, addresses and commit hashes in the same and other places. At most ``SAMPLE``
    rows, those of smallest hash.
    """
    listed = "array('" + "','".join(words) + "')" if words else "cast(array() as array<string>)"
    told = f"""lower(before) rlike '({_TOLD})s?[^a-z0-9]*[=:>][^a-z0-9]*((bearer|basic|token)[^a-z0-9]+)?$' or lower(before) rlike 'bearer[^a-z0-9]+$'"""
    mixed = " and ".join(f"value rlike '{k}'" for k in ("[a-z]", "[A-Z]", "[0-9]", "[!#$%&*?^~]"))
    label = rf"""case
        when value rlike '{FORMATS.replace(chr(92), chr(92) * 2)}' then 1
        when value rlike '^[0-9]+([.:/-][0-9]+){{1,9}}$' or value rlike '^[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}$' then 0
        when array_contains({listed}, lower(value)) or value rlike '^([$%]?[{{][^}}]*[}}]+|[$][A-Z_]+|<[^>]*>|[*]+|[xX]+|[.]+|(?i:null|none|true|false))$' then 0
        when {told} then case
            when value rlike '^[0-9a-f]{{16,}}$' or (value rlike '^[A-Za-z0-9+/_.-]{{24,}}={{0,2}}$' and value rlike '[0-9]') then 1
            when length(value) between 8 and 64 and value not like '% %' and {mixed} then 1 end
        when value rlike '^[0-9]+$' then 0
        when value rlike '^[0-9a-f]+$' and lower(before) rlike '(commit|checksum|revision|digest|etag|md5|sha1|sha256)[^a-z0-9]*$' then 0
        when length(value) < 200 and value rlike '^[/~]?([A-Za-z]?[a-z]+|v?[0-9]{{1,4}})([/._-]([A-Za-z]?[a-z]+|v?[0-9]{{1,4}}))+$' then 0
    end"""
    own = candidates(docs, key, text).select("value", "before", "after", F.expr(label).alias("label"))
    own = own.where("label is not null").distinct().orderBy(F.xxhash64("value", "before"), "value", "before", "after").limit(SAMPLE // 2)
    if not words:
        return own
    keys = docs.select(F.xxhash64(key).alias("h")).distinct().orderBy("h").limit(MADE_FROM)
    pick = lambda n: f"element_at({listed}, cast(pmod(xxhash64(h, {n}), {len(words)}) as int) + 1)"
    seed = keys.selectExpr("h", f"{pick(1)} as a", f"{pick(2)} as b", "md5(cast(h as string)) as m", "sha1(cast(h as string)) as s", "pmod(h, 90) + 10 as n",
        "translate(base64(unhex(sha2(cast(h as string), 256))), '+/=', 'xY') as r")
    made = """
        'password: ' | left(r, 10) | ' ' | 1;          'pwd=' | concat(initcap(a), '$', n, '!', left(r, 3)) | ' ' | 1;     'passwd=' | concat(left(r, 4), '%', right(r, 5)) | ' ' | 1;
        'secret=\\'' | concat(left(r, 7), '!', substr(r, 8, 3), '#', substr(r, 11, 2)) | '\\'' | 1;  'passphrase: "' | substr(translate(r, '0123456789', '!#*qWeKzvJ'), 3, 14) | '"' | 1;
        'Bearer ' | r | ' ' | 1;  'Authorization: Bearer ' | concat('eyJ', left(r, 20), '.eyJ', substr(r, 5, 30), '.', right(r, 28)) | ' ' | 1;  'auth_token_prod=' | left(r, 32) | ' ' | 1;
        concat(a, ' ') | concat('ghp_', left(r, 36)) | ' ' | 1;  concat(a, ' ') | concat('sk_live_', left(r, 24)) | ' ' | 1;  'key "' | concat('AIza', left(r, 35)) | '"' | 1;
        concat(a, ' ') | concat('eyJ', left(r, 24), '.eyJ', substr(r, 7, 32), '.', right(r, 22)) | ' ' | 1;  concat(a, ' is ') | concat(left(s, 11), '-', substr(s, 12, 12), '-', left(r, 24)) | ' ' | 1;
        'password: ' | b | ' ' | 0;  'token=' | concat(a, '_', b) | ' ' | 0;  'auth: ' | initcap(a) | ' ' | 0;  'secret: "' | concat(a, ' ', b) | '"' | 0;  'bearer ' | a | ' ' | 0;
        'password: ' | concat('${', a, '}') | ' ' | 0;  'api_key=' | concat('<', a, '-', b, '>') | ' ' | 0;  'pwd=' | repeat('*', n % 9 + 3) | ' ' | 0;  'password="' | repeat('x', n % 9 + 3) | '"' | 0;
        'tokens: ' | concat(n, '') | ' ' | 0;  'token = ' | concat(a, '.', b, '()') | ' ' | 0;  'secret=' | concat('$', upper(a), '_', upper(b)) | ' ' | 0;  'token_limit: ' | concat(n, '00') | ' ' | 0;
        'token = "' | s | '"' | 1;          'password=' | left(m, 18) | ' ' | 1;      'secret: ' | base64(unhex(m)) | ' ' | 1;
        concat(a, ' ') | concat('AKIA', translate(upper(left(m, 16)), '0189', 'QXYZ')) | ' ' | 1;
        'api_key="' | concat(left(s, 20), upper(right(s, 12))) | '"' | 1;
        'password=' | concat(a, b, n) | ' ' | 0;  'token = "' | concat(a, '-', b, '-', n) | '"' | 0;  'secret: ' | concat(a, '_', b, '_here', n) | ' ' | 0;
        concat(a, ' ') | concat('/', a, '/', b, '/v', n, '/index.html') | ' ' | 0;  concat(a, ' ') | concat(b, '.', n, '@mail', n, '.example.com') | ' ' | 0;
        concat(a, ' ') | concat(n, '.', n + 7, '.', n + 100, '.', n + 31) | ' ' | 0;  'version ' | concat(n, '.2.1-', a, '-release') | ' ' | 0;
        concat(a, ' ') | left(conv(left(m, 14), 16, 10), 16) | ' ' | 0;  'commit ' | s | ' ' | 0;  'checksum: ' | m | ' ' | 0;  concat(a, ', ') | concat(a, b, n, a) | '.' | 0
    """
    rows = [[p.strip() for p in row.split(" | ")] for row in made.split(";")]
    each = ", ".join(f"struct({v} as value, concat({w}, ' ', {before}) as before, {after} as after, {label} as label)" for (before, v, after, label), w in zip(rows, ["a", "b"] * len(rows), strict=False))
    other = seed.select(F.explode(F.expr(f"array({each})")).alias("f")).select("f.*").where(F.expr(f"length(value) >= 12 or {told}"))
    return own.unionByName(other.orderBy(F.xxhash64("value", "before"), "value", "before").limit(SAMPLE // 2))


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees side by side: inner ones have a feature, a threshold and children, leaves a vote."""

    dictionary: list[str]
    roots: list[int]
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    vote: list[float]
    depth: int

    @classmethod
    def always(cls, words: list[str], vote: float = 1.0) -> Forest:
        return cls(words, [0], [-1], [0.0], [0], [0], [vote], 1)

    @classmethod
    def of_trees(cls, words: list[str], trees: list[str], depth: int) -> Forest:
        """From the printed form of trees."""
        roots, feature, threshold, left, right, vote = [], [], [], [], [], []

        def node() -> int:
            for column, value in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (vote, 0.0)):
                column.append(value)
            return len(feature) - 1

        for tree in trees:
            open_: list[tuple[int, bool]] = []  # inner nodes above, and whether their left child is due
            for line in tree.splitlines():
                line = line.strip()
                if line.startswith("Else"):
                    while not open_[-1][1]:
                        open_.pop()
                    open_[-1] = (open_[-1][0], False)
                elif line.startswith(("If", "Predict")):
                    me = node()
                    if not open_:
                        roots.append(me)
                    elif open_[-1][1]:
                        left[open_[-1][0]] = me
                    else:
                        right[open_[-1][0]] = me
                    if line.startswith("If"):
                        split = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
                        feature[me], threshold[me] = int(split[1]), float(split[2])
                        open_.append((me, True))
                    else:
                        vote[me] = float(line.split(":")[1])
                        if open_ and not open_[-1][1]:
                            while open_ and not open_[-1][1]:
                                open_.pop()
        return cls(words, roots, feature, threshold, left, right, vote, depth)

    def score(self, features: str) -> str:
        """SQL of the share of trees that vote for a secret, from an array of features."""
        numbers = lambda values, kind: f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"
        feature, threshold = numbers(self.feature, "int"), numbers(self.threshold, "double")
        left, right, vote = numbers(self.left, "int"), numbers(self.right, "int"), numbers(self.vote, "double")
        step = f"if({feature}[n] < 0, n, if({features}[{feature}[n]] <= {threshold}[n], {left}[n], {right}[n]))"
        leaf = f"aggregate(sequence(1, {self.depth}), r, (n, _) -> {step})"
        return f"aggregate({numbers(self.roots, 'int')}, 0D, (sum, r) -> sum + {vote}[{leaf}]) / {len(self.roots)}"


def fit(findings: DataFrame, words: list[str]) -> Forest:
    """A forest from labelled findings (value, before, after, label); rows with a NULL among them are left out."""
    rows = findings.select(F.struct("value", "before", "after").alias("c"), F.col("label").cast("double")).where("c.value is not null and c.before is not null and c.after is not null and label is not null")
    # The bounded sample is drawn by hash; rows are put in order only after it.
    rows = rows.orderBy(F.xxhash64("c"), "c", "label").limit(SAMPLE)
    known = written(rows.select("label", F.expr(_features(words)).alias("f")).orderBy("f", "label").coalesce(1), "findings")
    kinds = [r[0] for r in known.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Forest.always(words, kinds[0] if kinds else 1.0)
    trainer = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7)
    model = trainer.fit(known.select("label", array_to_vector("f").alias("x")))
    return Forest.of_trees(words, [t.toDebugString for t in model.trees], DEPTH)


def scanned(docs: DataFrame, forest: Forest, text: str = "text", names: tuple[str, str] = ("candidates", "clean_text")) -> DataFrame:
    """``docs`` plus its candidates (start, length, score, secret) and the text with its secrets masked.

    ``start`` counts characters from 1. The two columns replace ones of the same names.
    """
    matches, parts, listed, scores, found, masked_text = unused(docs, "__matches", "__parts", "__listed", "__scores", "__spans", "__clean")
    cut = _cut(docs, text, matches, parts).withColumn(listed, F.expr(f"transform({_listed(matches, parts)}, c -> {_features(forest.dictionary)})"))
    judged = cut.withColumn(scores, F.expr(f"transform({listed}, f -> {forest.score('f')})"))
    # Ends of the stretches and candidates so far, one after the other.
    ends = f"""aggregate({matches}, cast(array(0) as array<int>), (e, m) ->
        concat(e, array(e[size(e) - 1] + length({parts}[size(e) - 1]) + length(m))))"""
    spans = f"""transform(arrays_zip({matches}, {scores}, slice({ends}, 2, size({matches}))), (z, i) -> struct(
        z['2'] - length(z['0']) + 1 as start, length(z['0']) as length, z['1'] as score, z['1'] >= {THRESHOLD} as secret))"""
    spans = spans.replace("z['0']", f"z.{matches}").replace("z['1']", f"z.{scores}")
    rebuilt = f"""array_join(transform({parts}, (p, i) -> if(i < size({matches}), concat(p, if({scores}[i] >= {THRESHOLD}, '{MASK}', {matches}[i])), p)), '')"""
    kind = "array<struct<start:int,length:int,score:double,secret:boolean>>"
    out = judged.withColumn(found, F.when(F.size(matches) > 0, F.expr(spans)).otherwise(F.array()).cast(kind))
    out = out.withColumn(masked_text, F.when(F.size(matches) > 0, F.expr(rebuilt)).otherwise(F.col(text)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return out.select(*kept, F.col(found).alias(names[0]), F.col(masked_text).alias(names[1]))


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Forest:
    """A forest from the corpus's own findings and dictionary."""
    words = dictionary(docs, text)
    return fit(labelled_findings(docs, words, key, text), words)


def masked(docs: DataFrame, forest: Forest, text: str = "text", length: str | None = None) -> DataFrame:
    """The documents with secrets masked; ``length`` names a column that counts the text's characters."""
    names = unused(docs, "__candidates", "__clean_text")
    found = scanned(docs, forest, text, names)
    new: dict[str, Column] = {text: F.col(names[1])}
    if length:
        kind = dict(docs.dtypes)[length]
        hit = F.exists(names[0], lambda c: c["secret"])
        new[length] = F.when(hit, F.length(names[1]).cast(kind)).otherwise(F.col(length))
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
