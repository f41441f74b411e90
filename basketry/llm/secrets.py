"""Secrets in text: candidates by pattern, false positives removed by a random forest.

Everything is a DataFrame expression: the candidates with their places and neighbouring words, their features, and the
forest of ``pyspark.ml``, which is trained and applied inside Spark.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.llm.common import whole

THRESHOLD = 0.5
#: Characters before and after a candidate whose words are features.
NEAR = 48
_CHARS = r"A-Za-z0-9_+/.\-"
_NAME = r"[A-Za-z0-9_.\-]"
PREFIX = "AKIA|ASIA|gh[pousr]_|sk_live_|xox[abp]-|AIza|eyJ|glpat-|SG[.]"

# Words of the features.
ASSIGNING = "token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access|client|signing|webhook|session|key"
_SIGN = r"[\"'`\]]{0,2}\s{0,4}(?:=>|:=|==?|:)\s{0,4}"
# The user of an address with a password: scheme://user:password@host.
_USER = r"://[^\s/:@\"'<>]{0,64}:"
_PASSWORD = r"[^\s/@\"'<>]{4,200}+"
# An assigning word, the rest of its name and what stands before the value.
_HEAD = (
    rf"[A-Za-z][A-Za-z0-9+.\-]{{0,20}}{_USER}(?={_PASSWORD}@)"
    rf"|[?&]{_NAME}{{0,64}}?(?i:{ASSIGNING}){_NAME}{{0,64}}+="
    rf"|(?i:{ASSIGNING}){_NAME}{{0,64}}+{_SIGN}[\"'`]?(?:(?i:bearer|basic|token)\s{{1,2}})?"
    r"|(?i:bearer)\s{1,2}"
)
# Its value: up to the closing quote, to the end of a part of a query string, or to white space and brackets.
_VALUE = (
    rf"""(?<={_USER}){_PASSWORD}(?=@)|"""
    r"""(?<=")(?:\\.|[^"\\\n]){4,}+(?=")|(?<=')(?:\\.|[^'\\\n]){4,}+(?=')|(?<=`)[^`\n]{4,}+(?=`)"""
    rf"""|(?<=[?&]{_NAME}{{0,140}}=)[^\s"'`&#<>]{{4,}}+"""
    rf"""|(?<!["'`])(?<![?&]{_NAME}{{0,140}}=)[^\s"'`,;<>(){{}}\[\]]{{3,}}[^\s"'`,;<>(){{}}\[\].:]"""
)
# A run of 16 characters or more of keys, hashes and encodings, with a digit or the prefix of a known token, and its
# padding. The name before a "=" or before the value of an assigning word is none.
_RUN = (
    rf"(?<![{_CHARS}])(?=[{_CHARS}]{{16}})(?:(?=[A-Za-z_+/.\-]*+[0-9])|(?={PREFIX}))(?![A-Za-z_]{_NAME}*+=[{_CHARS}])"
    rf"(?!{_NAME}{{0,64}}?(?i:{ASSIGNING}){_NAME}{{0,64}}+{_SIGN}[^\s])[{_CHARS}]{{16,}}+={{0,3}}+"
)
#: What may be a secret; its first group is what stands before the value of an assigning word.
CANDIDATE = rf"({_HEAD})(?:{_VALUE})|{_RUN}"

HARMLESS = (
    "example|sample|dummy|placeholder|redacted|checksum|sha1|sha256|sha512|md5|hash|commit|revision|digest|uuid|guid|"
    "version|build|order|invoice|tracking|phone|card|account|isbn|serial|file|url|path|image|mail"
)
DICTIONARY = (
    "example|sample|test|dummy|placeholder|changeme|replace|your|password|secret|token|value|user|name|data|config|"
    "default|service|handler|manager|factory|controller|message|request|response|index|image|content|version|release|"
    "build|local|host|http|www|com|org|net|file|path|home|mail|the|and|for|with|from|this|that|have|not|are|tion|ing|ment"
)
TEST_PATH = "test|example|sample|mock|fixture|docs?/|vendor|node_modules|readme|spec"

FEATURES = (
    "length", "digits", "upper", "distinct", "letter_to_digit", "digit_to_letter", "case_changes", "vowel_pairs",
    "consonant_runs", "punctuation", "hex_only", "digits_only", "dictionary", "prefix", "dots", "at_sign",
    "assigning", "harmless", "assigned", "quoted", "repeated", "test_path", "named", "symbols", "spaces", "letters_only",
    "lower_only", "code", "placeholder", "address_password",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row per candidate: ``doc_id``, ``path``, ``start`` (1-based, in code points), ``candidate``, ``before``, ``after``.

    The text is cut at its candidates; the pieces between them are their surroundings, their lengths the places.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), whole(text_col).alias("text")
    ).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select(
        "doc_id",
        "path",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)).alias("heads"),
        F.split("text", CANDIDATE, -1).alias("gaps"),
    ).withColumn("lengths", F.zip_with("found", F.slice("gaps", F.lit(1), F.size("found")), lambda c, g: F.length(c) + F.length(g)))
    pieces = F.transform(
        "found",
        lambda c, i: F.struct(
            (
                F.aggregate(F.slice("lengths", F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) - F.length(c) + F.length(F.get("heads", i)) + 1
            ).alias("start"),
            F.substr(c, F.length(F.get("heads", i)) + 1).alias("candidate"),
            F.right(F.concat(F.get("gaps", i), F.get("heads", i)), F.lit(NEAR)).alias("before"),
            F.left(F.concat(F.get("gaps", i + 1), F.coalesce(F.get("heads", i + 1), F.lit(""))), F.lit(NEAR)).alias("after"),
        ),
    )
    return rows.select("doc_id", "path", F.inline(pieces))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """``found`` (``candidate``, ``before``, ``after``, ``path``; nulls count as empty) with the columns ``FEATURES``."""
    text, path = F.coalesce("candidate", F.lit("")), F.lower(F.coalesce("path", F.lit("")))
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))
    low = F.lower(text)
    size = F.greatest(F.length(text), F.lit(1))
    yes = lambda c: c.cast("double")
    values = {
        "length": F.least(size, F.lit(200)).cast("double"),
        "digits": _share(text, "[0-9]"),
        "upper": _share(text, "[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / size,
        "letter_to_digit": _share(text, "(?<=[A-Za-z])(?=[0-9])"),
        "digit_to_letter": _share(text, "(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": _share(text, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_pairs": _share(low, "[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "consonant_runs": _share(low, "[b-df-hj-np-tv-z]{4,}"),
        "punctuation": _share(text, r"[_+/=.\-]"),
        "hex_only": yes(low.rlike("^[0-9a-f]+$")),
        "digits_only": yes(text.rlike(r"^[0-9.\-]+$")),
        "dictionary": (F.length(low) - F.length(F.regexp_replace(low, f"({DICTIONARY})", ""))) / size,
        "prefix": yes(text.rlike(f"^({PREFIX})")),
        "dots": _share(text, "[.]"),
        "at_sign": yes(before.rlike("@$") | after.startswith("@")),
        "assigning": yes(before.rlike(f"({ASSIGNING})")),
        "harmless": yes(before.rlike(f"({HARMLESS})")),
        "assigned": yes(before.rlike("[=:]\\s*[\"'`]?$")),
        "quoted": yes(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "repeated": yes(text.rlike(r"(.)\1{4,}")),
        "test_path": yes(path.rlike(f"({TEST_PATH})")),
        "named": yes(before.rlike(rf"(token|secret|passw|pwd|api.?key|credential|access.?key|private.?key|bearer)[\w.\-]*[\"'`\]]*\s*[=:>]*\s*[\"'`]?$")),
        "symbols": _share(text, r"[^A-Za-z0-9_+/=.\-\s]"),
        "spaces": _share(text, r"\s"),
        "letters_only": yes(low.rlike("^[a-z]+$")),
        "lower_only": yes(text.rlike(r"^[a-z\s]+$")),
        "code": yes(after.rlike(r"^\s?[(\[{]")),
        "placeholder": yes(low.rlike(r"^[<$%{\[]|[>}\]]$|^(none|null|true|false|self[.].*|changeme|redacted|\*+|x+|[.]+)$|os[.]environ|your|example|placeholder")),
    }
    values["address_password"] = yes(before.rlike(r"://[^\s/:@]{0,64}:$") & after.startswith("@"))
    return found.withColumns({name: values[name].cast("double") for name in FEATURES})


def labelled_findings(spark: SparkSession, count: int = 3000) -> DataFrame:
    """Findings of known kinds: ``candidate``, ``before``, ``after``, ``path``, ``label`` (1.0: a secret).

    Made by a rule from row numbers, so they are the same in every run. Secrets: keys, tokens and passwords with
    their assignments. Others: checksums, commits, identifiers of code, numbers, addresses, placeholders, words.
    """
    hex_, h2 = "md5(cast(id as string))", "sha2(concat('s', id), 256)"
    b64 = "translate(base64(unhex(sha2(concat('b', id), 256))), '=', 'A')"
    word = "element_at(array('service','message','handler','release','content','thention','ingreat','request'), cast(id % 8 + 1 as int))"
    name = "element_at(array('password', 'secret', 'token', 'api_key', 'DB_PASSWORD', 'client_secret', 'pwd', 'auth_token'), cast(id / 13 % 8 + 1 as int))"
    weak = "element_at(array('key', 'author', 'client', 'access', 'session', 'keyboard', 'private', 'the key'), cast(id / 13 % 8 + 1 as int))"
    small = "translate(substr(md5(concat('w', id)), {}, {}), '0123456789abcdef', 'lmnoprstuiaeeaio')"
    lower, lower2, number = small.format(1, "6 + id % 5"), small.format(12, "5 + id % 4"), "cast(id * 7 % 90 + 1 as string)"
    password = "concat(substr(base64(unhex(md5(concat('p', id)))), 1, 5), element_at(array('&', '!', '$', '@', '#', '-'), cast(id / 5 % 6 + 1 as int)), id % 10, substr(base64(unhex(md5(concat('q', id)))), 1, 2 + cast(id % 9 as int)), element_at(array('!', '', '#', '?'), cast(id / 3 % 4 + 1 as int)))"
    letters = "translate(substr(base64(unhex(sha2(concat('l', id), 256))), 1, 16 + cast(id % 20 as int)), '0123456789+/=', 'QwErTyUiOpAsD')"
    kinds = [  # candidate, before, after, label
        (f"substr({h2}, 1, 40)", "element_at(array('token = \"', 'secret: \"', 'api_key=\"', 'auth_token = \"'), cast(id / 23 % 4 + 1 as int))", "'\"'", 1),
        (f"upper(substr({h2}, 1, 40))", "'TOKEN = \"'", "'\"'", 1),
        (hex_, "'password: '", "''", 1),
        (b64, "'client_secret=\"'", "'\"'", 1),
        (f"concat('ghp_', substr({b64}, 1, 36))", "'use '", "' now'", 1),
        (f"concat('AKIA', upper(substr({h2}, 1, 16)))", "'access key '", "''", 1),
        (f"concat('eyJ', {b64}, '.', substr({b64}, 3, 30))", "'Bearer '", "''", 1),
        (f"concat('sk_live_', substr({b64}, 1, 24))", "'key: '", "''", 1),
        (f"substr({h2}, 3, 40)", "'the word token = \"'", "'\" and on'", 1),
        (password, f"concat({name}, ' = \"')", "'\"'", 1),
        (password, f"concat({name}, ': ')", "element_at(array('', ' and', ', '), cast(id / 31 % 3 + 1 as int))", 1),
        (f"substr({password}, 1, 8)", f"concat({name}, '=\"')", "'\"'", 1),
        (f"concat({lower}, {lower})", "element_at(array('password = \"', 'passwd: \"', 'secret = \"', 'db_password=\"'), cast(id / 23 % 4 + 1 as int))", "'\"'", 1),
        (f"concat({lower}, {number}, {lower}, {number})", f"concat({name}, ' = \"')", "'\"'", 1),
        (letters, f"concat({name}, ': \"')", "'\"'", 1),
        (letters, f"concat({name}, '=')", "''", 1),
        (f"concat_ws(' ', {lower}, {lower2}, {lower}, {number})", "element_at(array('password = \"', 'passphrase: \"', 'secret = \"'), cast(id / 23 % 3 + 1 as int))", "'\"'", 1),
        (f"substr({h2}, 1, 40)", "element_at(array('API_KEY=', 'export SECRET=', '?access_token=', 'AUTH_TOKEN='), cast(id / 23 % 4 + 1 as int))", "element_at(array('', '&page=1', ' '), cast(id / 31 % 3 + 1 as int))", 1),
        (f"concat('ghp_', substr({b64}, 1, 36))", "element_at(array('GITHUB_TOKEN=', 'token=', 'git clone x?token='), cast(id / 23 % 3 + 1 as int))", "''", 1),
        (lower, f"concat({weak}, ': ')", "element_at(array(' and', '', ', the'), cast(id / 31 % 3 + 1 as int))", 0),
        (word, f"concat({weak}, ' = ')", "element_at(array('', '(', ' + 1'), cast(id / 31 % 3 + 1 as int))", 0),
        (word, f"concat({name}, ': ')", "' and'", 0),
        (lower, "element_at(array('token: ', 'the secret: ', 'password: '), cast(id / 23 % 3 + 1 as int))", "' is'", 0),
        (f"concat('get_', {word}, '.next')", f"concat({name}, ' = ')", "'('", 0),
        (f"concat('self.', {word})", f"concat({name}, '=')", "''", 0),
        (f"concat({word}, ' ', {lower}, ' ', {word})", f"concat({weak}, ' = \"')", "'\"'", 0),
        (f"concat_ws(' ', {lower}, {lower2}, {lower}, {lower2})", f"concat({weak}, ' = \"')", "'\"'", 0),
        (f"concat('20', 10 + id % 20, '-', 10 + id % 3, '-', 10 + id % 19)", f"concat({weak}, ': ')", "''", 0),
        (f"concat('https://www.', {lower}, '.com/', {word})", f"concat({weak}, ': \"')", "'\"'", 0),
        ("cast(id * 37 + 1000 as string)", f"concat({weak}, '=')", "''", 0),
        (f"concat('${{', upper({word}), '}}')", f"concat({name}, ' = \"')", "'\"'", 0),
        ("element_at(array('changeme', 'your-password-here', '<password>', 'none', 'null', 'true', '********', 'placeholder', 'xxxxxxxx'), cast(id / 23 % 9 + 1 as int))", f"concat({name}, ' = \"')", "'\"'", 0),
        ("element_at(array('none', 'null', 'true', 'false', 'request', 'value'), cast(id / 23 % 6 + 1 as int))", f"concat({name}, ' = ')", "''", 0),
        (f"substr({h2}, 1, 40)", "element_at(array('BUILD_COMMIT=', 'sha1=', 'REVISION=', 'checksum='), cast(id / 23 % 4 + 1 as int))", "' '", 0),
        (f"substr({h2}, 1, 40)", "element_at(array('commit ', 'sha1: ', 'revision ', 'checksum = \"'), cast(id / 23 % 4 + 1 as int))", "' by'", 0),
        (h2, "'sha256:'", "''", 0),
        (hex_, "'md5 '", "''", 0),
        (f"concat_ws('-', substr({hex_}, 1, 8), substr({hex_}, 9, 4), substr({hex_}, 13, 4), substr({hex_}, 17, 12))", "'uuid '", "''", 0),
        ("lpad(cast(abs(xxhash64(id)) as string), 16, '7')", "'the word '", "' and'", 0),
        ("concat_ws('.', '100' + id % 150, '110' + id % 99, '120' + id % 9, '101' + id % 130, '2')", "'host '", "''", 0),
        (f"concat({word}, '.', {word}, cast(id % 90 as string))", "'see '", "'@mail'", 0),
        (f"concat('mail', id % 9, '.example.com.', {word})", "'me@'", "''", 0),
        (f"concat({word}, 'Manager', {word}, id % 10)", "'class '", "'('", 0),
        (f"concat('src/', {word}, '/', {word}, id % 10, '.java')", "'file '", "''", 0),
        (f"concat('your-', {word}, '-token-example', id % 10)", "'token = \"'", "'\"'", 0),
        (password, "element_at(array('postgres://admin:', 'DB=mysql://app:', 'https://bot:', 'redis://:'), cast(id / 23 % 4 + 1 as int))", "concat('@db', id % 9, '.host/main')", 1),
        (f"concat({lower}, {number}, {lower})", "element_at(array('amqp://queue:', 'mongodb+srv://root:', 'ftp://me:'), cast(id / 23 % 3 + 1 as int))", "concat('@', 'h', id % 9)", 1),
        ("element_at(array('password', '<password>', '${PASSWORD}', '******', 'your-password', 'changeme'), cast(id / 23 % 6 + 1 as int))", "element_at(array('postgres://user:', 'https://user:', 'mysql://root:'), cast(id / 29 % 3 + 1 as int))", "'@localhost'", 0),
        ("concat('xxxxxxxxxxxxxxxxxxxx', id % 10)", "'secret: \"'", "'\"'", 0),
        (f"concat('EXAMPLE', upper({word}), 'KEY1234567')", "'api_key=\"'", "'\"'", 0),
        (f"concat('=====', '----------', id % 10, {word})", "'line '", "''", 0),
    ]
    pick = lambda at: "CASE " + " ".join(f"WHEN kind = {k} THEN {row[at]}" for k, row in enumerate(kinds)) + " END"
    lead = "element_at(array('', 'and the ', 'x = f(a); ', 'ing of thention. '), cast(id / 7 % 4 + 1 as int))"
    return spark.range(count).withColumn("kind", F.col("id") % len(kinds)).select(
        F.expr(pick(0)).alias("candidate"),
        F.concat(F.expr(lead), F.expr(pick(1))).alias("before"),
        F.expr(pick(2)).alias("after"),
        F.expr("element_at(array('src1', 'src12', 'app/main.py', 'conf/prod.yaml', 'lib/a.go'), cast(id / 11 % 5 + 1 as int))").alias("path"),
        F.expr(pick(3)).cast("double").alias("label"),
    )


def train_forest(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5) -> PipelineModel:
    """Fit on labelled findings (``candidate``, ``before``, ``after``, ``path``, ``label``)."""
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt"
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(with_features(labelled))


def scan_secrets(
    docs: DataFrame,
    model: PipelineModel | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """A row per finding that stays: ``doc_id``, ``path``, ``start``, ``secret``, ``score``.

    ``start`` counts code points from 1. A null text has no finding; null ids and paths are kept; repeated rows have
    repeated findings; empty tables an empty result. Texts are read whole; other columns are not read. Documents are
    scanned where they lie, without a shuffle. Values of assigning words are candidates from 4 characters on, quoted ones
    up to the closing quote, and so are passwords of addresses (``scheme://user:password@host``); other runs from 16
    characters on, with a digit or the prefix of a known token. A name before ``=`` is no part of a secret.
    """
    model = model or train_forest(labelled_findings(docs.sparkSession))
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select("doc_id", "path", "start", F.col("candidate").alias("secret"), score.alias("score")).where(
        F.col("score") >= threshold
    )
