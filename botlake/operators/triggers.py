"""Message triggers: all trigger words of a number found in one pass over each message."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triggers that are sent to every task at most; more of them are joined.
MOST_TRIGGERS = 100_000


class NumberTriggers:
    """The triggers of one number: an Aho-Corasick automaton over their words, and those that any text fires."""

    def __init__(self, triggers: list[tuple[str, tuple[str, ...] | None, str, str]]):
        import ahocorasick

        self.any: list[str] = []
        self.any_from: dict[str, list[str]] = defaultdict(list)
        words: dict[str, list[tuple[str, frozenset | None, bool]]] = defaultdict(list)
        for trigger, senders, match, word in triggers:
            if match in ("contains", "starts"):
                if word:
                    words[word].append((trigger, None if senders is None else frozenset(senders), match == "starts"))
            elif senders is not None:
                for sender in set(senders):
                    self.any_from[sender].append(trigger)
            else:
                self.any.append(trigger)
        self.words = ahocorasick.Automaton() if words else None
        for word, meant in words.items():
            self.words.add_word(word, (word, meant))
        if words:
            self.words.make_automaton()

    def fired(self, phone: str | None, text: str) -> list[str]:
        """Triggers that a lower-cased text of this sender fires."""
        out = [*self.any, *self.any_from.get(phone, ())]
        if self.words is None or not text:
            return out
        start = len(text) - len(text.lstrip(" "))
        inside, first = {}, set()
        for end, (word, meant) in self.words.iter(text):
            inside[word] = meant
            if end - len(word) + 1 == start:
                first.add(word)
        for word, meant in inside.items():
            out += [t for t, senders, starts in meant if (not starts or word in first) and (senders is None or phone in senders)]
        return out


def match_messages(messages: DataFrame, triggers: DataFrame) -> DataFrame:
    """(message_id, trigger_id) of the same number: sender allowed (an empty list allows all), then any text, contains or starts, case folded.

    messages (a table or a stream): id, number_id, phone, text; triggers (a table): trigger_id, number_id, senders (array), match, words. Up to MOST_TRIGGERS triggers go to every task, which builds an
    automaton a number when its first message comes; each message is read once, whatever the number of triggers. More triggers are joined by number. Null texts are empty; a null number or an empty word matches nothing.
    """
    want = F.lower(F.trim(F.coalesce("words", F.lit("")))).alias("want")
    rules = triggers.where(F.col("number_id").isNotNull()).select("trigger_id", "number_id", "senders", "match", want)
    texts = messages.where(F.col("number_id").isNotNull()).select(F.col("id").alias("message_id"), "number_id", "phone", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    found = rules.limit(MOST_TRIGGERS + 1).collect()
    if len(found) > MOST_TRIGGERS:
        allowed = (F.coalesce(F.size("senders"), F.lit(0)) <= 0) | F.array_contains("senders", F.col("phone"))
        fits = F.when(F.col("match") == "contains", (F.col("want") != "") & F.contains("t", "want")).when(F.col("match") == "starts", (F.col("want") != "") & F.startswith(F.ltrim("t"), F.col("want"))).otherwise(True)
        return texts.join(rules, "number_id").where(F.coalesce(allowed, F.lit(False)) & fits).select("message_id", "trigger_id")
    by: dict[str, list[tuple]] = defaultdict(list)
    for r in found:
        by[r["number_id"]].append((r["trigger_id"], tuple(x for x in r["senders"] if x is not None) if r["senders"] else None, r["match"], r["want"]))
    shared = messages.sparkSession.sparkContext.broadcast(dict(by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[str, NumberTriggers] = {}
        for b in batches:
            ids, fired = [], []
            for message, number, phone, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number not in built:
                    built[number] = NumberTriggers(shared.value.get(number, []))
                hits = built[number].fired(phone, text)
                ids += [message] * len(hits)
                fired += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(fired, pa.string())], names=["message_id", "trigger_id"])

    kind = dict(texts.dtypes)["message_id"]
    return texts.mapInArrow(run, f"message_id {kind}, trigger_id string")
