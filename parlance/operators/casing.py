"""Punctuation and case labels to text, filler words, sub-word coverage.

Labelled tokens are ``(doc, pos, token, punc_label, case_label)``; ``doc`` may be several columns and
stands for one text of one input row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.fixed import DISFLUENCIES, MAPPED_PUNCTUATION, PUNCTUATION_MARKS
from parlance.functions.text import EDGE_AFTER, EDGE_BEFORE
from parlance.operators.assemble import glue_apostrophes

LOWER, UPPER, CAPITALIZE, OTHER = range(4)
PERIOD = 2
#: Pieces of a vocabulary that every task may hold.
VOCABULARY_IN_MEMORY = 500_000
BOUNDARY_TOKENS = ("[CLS]", "[SEP]", "<s>", "</s>")


def drop_mapped_punct(text: Column) -> Column:
    return F.translate(text, MAPPED_PUNCTUATION, "")


def recase(token: Column, label: Column) -> Column:
    low = F.lower(token)
    return (
        F.when(label == LOWER, low)
        .when(label == UPPER, F.upper(token))
        .when(label == CAPITALIZE, F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2))))
        .otherwise(token)
    )


def sentence_case(tokens: DataFrame, doc: list[str]) -> DataFrame:
    """``case_eff``: the first token and those after a sentence mark are capitalized."""
    before = F.coalesce(F.lag("punc_label").over(Window.partitionBy(*doc).orderBy("pos")), F.lit(PERIOD))
    opens = (before > 1) & F.col("case_label").isin(LOWER, OTHER)
    return tokens.withColumn("case_eff", F.when(opens, F.lit(CAPITALIZE)).otherwise(F.col("case_label")))


def detokenize(tokens: DataFrame, doc: list[str], french: Column, compat: bool = False) -> DataFrame:
    """Labelled sub-word tokens to text, one row per document.

    The mark of a word follows its last piece. ``compat`` prints it after the first piece where
    pieces are marked with ``##``.
    """
    along = Window.partitionBy(*doc).orderBy("pos")
    mark = F.element_at(F.array(*[F.lit(m) for m in PUNCTUATION_MARKS]), F.col("punc_label") + 1)
    inner = F.startswith("token", F.lit("##"))
    closes = F.endswith("token", F.lit("</w>"))
    cased = sentence_case(tokens.filter(~F.col("token").isin(*BOUNDARY_TOKENS)), doc)
    pieces = (
        cased.withColumn("__fr", french)
        .withColumn("__starts", F.when(F.col("__fr"), F.coalesce(F.lag(closes).over(along), F.lit(True))).otherwise(~inner))
        .withColumn("__ends", F.when(F.col("__fr"), closes).otherwise(F.coalesce(~F.lead(inner).over(along), F.lit(True))))
        .withColumn(
            "__bare",
            F.when(F.col("__fr"), F.regexp_replace("token", "</w>$", "")).otherwise(F.regexp_replace("token", "^##", "")),
        )
    )
    marked = F.when(F.col("__fr"), F.col("__ends")).otherwise(F.col("__starts")) if compat else F.col("__ends")
    piece = F.concat(
        F.when(F.col("__starts") & (F.row_number().over(along) > 1), F.lit(" ")).otherwise(F.lit("")),
        recase(F.col("__bare"), F.col("case_eff")),
        F.when(marked, mark).otherwise(F.lit("")),
    )
    return (
        pieces.withColumn("__piece", piece)
        .groupBy(*doc)
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "__piece"))).alias("__all"),
            F.max_by("punc_label", "pos").alias("__last"),
        )
        .withColumn("text", F.array_join(F.transform("__all", lambda x: x["__piece"]), ""))
        .withColumn("text", F.concat("text", F.when(F.col("__last") == 0, F.lit(".")).otherwise(F.lit(""))))
        .withColumn("text", glue_apostrophes(F.col("text")))
        .drop("__all", "__last")
    )


# --- filler words -------------------------------------------------------------------------------


def _filler(word: str) -> str:
    return f" *{EDGE_BEFORE}{word}{EDGE_AFTER} *"


_NO_HITS = "cast(array() as array<struct<start:int,hit:string>>)"


def _by_language(lang: str | Column, of: Callable[[list[str]], Column], otherwise: Column) -> Column:
    """``of`` the filler words of each row's language, told by its first two letters."""
    if isinstance(lang, str):
        lang = F.lit(lang)
    code, out = F.lower(F.substring(lang, 1, 2)), None
    for known, words in DISFLUENCIES.items():
        out = F.when(code == known, of(words)) if out is None else out.when(code == known, of(words))
    return otherwise if out is None else out.otherwise(otherwise)


def find_disfluencies(text: Column, lang: str | Column) -> Column:
    """``array<struct<start, hit>>`` of the filler words of the text's language, by position.

    A language without a list has none, and neither has a null language.
    """

    def hits_of(words: list[str]) -> Column:
        found = []
        for word in words:
            hits = F.regexp_extract_all(text, F.lit(_filler(word)), F.lit(0))
            between = F.transform(F.split(text, _filler(word), -1), lambda p: F.length(p))
            lengths = F.transform(hits, lambda h: F.length(h))
            found.append(F.transform(hits, _placed(between, lengths)))
        return F.array_sort(F.concat(*found))

    return _by_language(lang, hits_of, F.expr(_NO_HITS))


def _placed(between: Column, lengths: Column) -> Callable[[Column, Column], Column]:
    """The i-th hit starts after i + 1 pieces of other text and i earlier hits."""

    def place(hit: Column, i: Column) -> Column:
        start = _sum(F.slice(between, F.lit(1), i + 1)) + _sum(F.slice(lengths, F.lit(1), i))
        return F.struct(start.alias("start"), hit.alias("hit"))

    return place


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def remove_disfluencies(text: Column, lang: str | Column) -> Column:
    """The text without the filler words of its language; other languages pass unchanged."""

    def without(words: list[str]) -> Column:
        out = text
        for word in words:
            out = F.regexp_replace(out, _filler(word), " ")
        return out

    return _by_language(lang, without, text)


def restore_disfluencies(text: Column, inserts: Column) -> Column:
    """Put hits back at their offset plus the number of marks that now stand before it."""

    def insert(acc: Column, ins: Column) -> Column:
        before = F.substr(text, F.lit(1), ins["start"])
        at = ins["start"] + F.length(before) - F.length(drop_mapped_punct(before))
        return F.concat(F.substr(acc, F.lit(1), at), F.rtrim(ins["hit"]), F.substr(acc, at + 1))

    return F.when(F.size(inserts) > 0, F.aggregate(inserts, text, insert)).otherwise(text)


# --- inputs of several shapes -------------------------------------------------------------------


def map_text_field(line: Column, operator: Callable[[Column], Column]) -> Column:
    """Apply ``operator`` to a text, or to the ``text`` field of a JSON object given as a string.

    A field that is no string, or is missing, is left alone, and so is a line in braces that is no
    JSON object; :func:`text_field_error` tells of the latter.
    """
    bare = F.trim(line)
    fields, text = _json_fields(bare)
    kind = F.try_variant_get(fields["text"], "$", "string")
    new_text = operator(kind)
    is_text = F.schema_of_variant(fields["text"]) == "STRING"
    changed = F.transform_values(
        fields, lambda k, v: F.when((k == "text") & F.coalesce(is_text, F.lit(False)), new_text.cast("variant")).otherwise(v)
    )
    return (
        F.when(bare == "", F.lit(""))
        .when(text, operator(bare))
        .when(fields.isNull(), bare)
        .otherwise(F.to_json(changed))
    )


def text_field_error(line: Column) -> Column:
    """Why :func:`map_text_field` left a line as it was; null where it did not."""
    bare = F.trim(line)
    fields, text = _json_fields(bare)
    return F.when(~text & (bare != "") & fields.isNull(), F.concat(F.lit("not a JSON object: "), bare))


def map_text_fields(lines: Column, operator: Callable[[Column], Column]) -> Column:
    """The same for each item of a list of lines."""
    return F.transform(lines, lambda line: map_text_field(line, operator))


def _json_fields(bare: Column) -> tuple[Column, Column]:
    """The fields of a line in braces (null if they cannot be read), and whether it is plain text."""
    is_object = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
    return F.from_json(F.when(is_object, bare), "map<string,variant>"), ~is_object


# --- sub-word coverage --------------------------------------------------------------------------

class Pieces:
    """A vocabulary in memory: its pieces, and the longest one by first character, at the start and behind it."""

    def __init__(self, pieces: list[str]):
        self.pieces = frozenset(pieces)
        self.longest: dict[tuple[bool, str], int] = {}
        for piece in self.pieces:
            for inner in {False, piece.startswith("##")}:
                body = piece[2:] if inner else piece
                if body:
                    at = (inner, body[0])
                    self.longest[at] = max(self.longest.get(at, 0), len(body))

    def split(self, word: str | None, max_chars: int) -> list[str]:
        """Longest pieces from left to right, as they are or in lower case; none for an unknown word."""
        out: list[str] = []
        size = len(word) if word else 0
        if not 0 < size <= max_chars:
            return out
        at = 0
        while at < size:
            mark, head = "##" if at else "", word[at]
            most = max(self.longest.get((at > 0, c), 0) for c in (head, head.lower()[:1]))
            for end in range(min(size, at + most), at, -1):
                own = mark + word[at:end]
                if own in self.pieces or own.lower() in self.pieces:
                    out.append(own)
                    at = end
                    break
            else:
                return []
        return out


def wordpiece_coverage(
    words: DataFrame, vocab: DataFrame, word: str = "word", max_chars: int = 100, in_memory: int = VOCABULARY_IN_MEMORY
) -> DataFrame:
    """Greedy longest-match pieces of every distinct word, with the word's count.

    ``vocab`` is one column ``piece``, of any size. Up to ``in_memory`` pieces, which are counted first,
    every task has the vocabulary and walks over its distinct words, so that only those are shuffled; a
    larger one is joined to the substrings of the words. Pieces are in the vocabulary as they are or in
    lower case; behind the start with ``##``. No pieces means that the word is unknown.
    Output: word, n, pieces, known.
    """
    counted = words.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    given = [row.piece for row in vocab.filter("piece is not null").select("piece").distinct().limit(in_memory + 1).collect()]
    if len(given) > in_memory:
        return _joined_coverage(counted, vocab, max_chars)
    shared = words.sparkSession.sparkContext.broadcast(given)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(shared.value)
        for batch in batches:
            pieces = [known.split(w, max_chars) for w in batch.column(0).to_pylist()]
            found = pa.array([bool(p) for p in pieces], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.list_(pa.string())), found], names=["word", "n", "pieces", "known"]
            )

    return counted.mapInArrow(walk, "word string, n long, pieces array<string>, known boolean")


def _joined_coverage(counted: DataFrame, vocab: DataFrame, max_chars: int) -> DataFrame:
    """The same for a vocabulary of any size.

    Each distinct word lists its substrings once, those in the vocabulary stay, and a fold over the
    word's own longest ones takes them from left to right.
    """
    spans = F.expr(
        f"""if(length(word) > {max_chars} or word = '', null, flatten(transform(sequence(1, length(word)), at ->
          transform(sequence(1, length(word) - at + 1), size -> struct(at, size)))))"""
    )
    listed = counted.select("word", F.explode(spans).alias("s")).select(
        "word", "s.at", "s.size", F.expr("concat(if(s.at > 1, '##', ''), substring(word, s.at, s.size))").alias("own")
    )
    forms = listed.withColumn("piece", F.explode(F.array_distinct(F.array("own", F.lower("own")))))
    longest = forms.join(vocab.select("piece").distinct(), "piece").groupBy("word", "at").agg(F.max("size").alias("size"))
    steps = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("steps"))
    fold = F.expr(
        """aggregate(sequence(1, length(word)), struct(1 as at, cast(array() as array<string>) as pieces), (acc, i) ->
          if(acc.at = i and steps[i] is not null,
             struct(i + steps[i] as at, concat(acc.pieces, array(concat(if(i > 1, '##', ''), substring(word, i, steps[i])))) as pieces), acc))"""
    )
    split = counted.join(steps, "word", "left").withColumn("walk", F.when(F.col("steps").isNotNull(), fold))
    whole = F.col("walk.at") == F.length("word") + 1
    none = F.expr("cast(array() as array<string>)")
    return split.select("word", "n", F.when(whole, F.col("walk.pieces")).otherwise(none).alias("pieces")).withColumn(
        "known", F.size("pieces") > 0
    )
