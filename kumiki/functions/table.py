"""The tokenizer as a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.batch import one_by_one
from ..operators.viterbi import RANKS

COLUMNS = "sent_id bigint, token_pos bigint, surface string, char_start bigint, char_end bigint, lex_type string, word_id bigint, left_id int, right_id int, word_cost int, total_cost bigint"


def register_tokenize(spark: SparkSession, tokenizer, name: str = "tokenize") -> None:
    """Makes ``name(text)`` a table function of the session: a row for each token of each line of a text.

        SELECT d.doc_id, t.* FROM documents d, LATERAL tokenize(d.text) t

    A null or empty text and a line without a path give no row.  The dictionary and options are the tokenizer's.
    """
    packed, (ignore_space, most_run) = tokenizer._compact, tokenizer.options

    class Tokenize:
        def eval(self, text: str) -> Iterator[tuple]:
            index = packed.value.open()
            for sent_id, line in enumerate((text or "").split("\n")):
                if line:
                    _, _, start, end, rank, *rest = (c.tolist() for c in one_by_one(index, [line], most_run, ignore_space))
                    for k, (a, b, r, *more) in enumerate(zip(start, end, rank, *rest)):
                        yield (sent_id, k, line[a:b], a, b, RANKS[r], *more)

    spark.udtf.register(name, udtf(Tokenize, returnType=COLUMNS))
