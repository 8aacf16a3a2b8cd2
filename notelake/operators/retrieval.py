"""Hybrid retrieval for many questions and many readers at once: BM25 and cosine, fused by reciprocal rank.

What a reader may see enters before any statistic, so hidden rows move no score. Rows that the same
readers may see form a *cell* (space, private, untrusted, reader list). Readers who see the same cells
share a *view*. Term statistics are counted once per cell and summed over a view's cells; a row carries the list of
views that see it, and is scored where it lies, once for each view with a question. No copy
of the corpus per reader is made; readers come in last, when a view's few results are handed to its readers.

Texts are parsed once, into the counts of the asked terms, the length and the vector. The fused order is
exact and needs two passes over that table, whatever the number of rows:

1. Every task keeps the first ``R = RRF_K + 2 * k`` rows of either leg for each pair of view and question. A row
   outside both legs' first R has at most 2 / (RRF_K + R), and the first k rows of a leg have more than 1 / (RRF_K + k), so it
   is not among the first k.
2. A candidate's rank on a leg is the number of rows above it there, which tasks count and a sum adds up.

So nothing is ranked in full, and no row leaves a task for a question that it cannot answer. Questions are taken
in groups and pairs in blocks, so what is broadcast is bounded whatever is asked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.text import tokens
from notelake.operators.query import visible_to
from notelake.operators.search import K1, RRF_K, B
from notelake.sources.notes import drop_kept, kept, text_batches

#: Questions whose terms and vectors are broadcast at a time; pairs of view and question in a pass; scores held at a time; rows a task holds before it drops the lower ones.
QUESTIONS, PAIRS, BLOCK_SCORES, HELD = 16_384, 4_096, 500_000, 250_000
#: Scores are compared as whole millionths.
MILLION = 1_000_000
_TOKEN = re.compile("[a-z0-9]+")
_LOWEST = -(1 << 62)

CELL = ("space", "private", "untrusted", "readers")


def cells_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cell``: what decides who may see a row, spelled out."""
    return rows.withColumn("cell", F.to_json(F.struct("space", "private", "untrusted", F.array_sort(F.array_distinct("readers")).alias("readers"))))


def views_of(cells: DataFrame, principals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((user, view), (view, cell)) of distinct cells (cell, space, private, untrusted, readers); users who see the same cells share a view."""
    seen = visible_to(cells, principals, readers="readers", untrusted="untrusted").select("user", "cell")
    whole = seen.groupBy("user").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    named = kept(whole.withColumn("view", F.min("user").over(Window.partitionBy("cells"))), "views")
    return named.select("user", "view"), named.where("user = view").select("view", F.explode("cells").alias("cell"))


def statistics_as(rows: DataFrame, principals: DataFrame, note: str = "note", text: str = "text") -> DataFrame:
    """(user, chunks, notes, chars, tokens, avg_tokens) of what each principal sees; a note's chunks share a cell.

    Counted per cell and summed, so the work is that of the corpus and not of corpus times principals.
    """
    r = cells_of(rows).withColumns({"__chars": F.length(text), "__tokens": F.size(tokens(F.col(text)))})
    # null texts are chunks without a length; first per note, so that counting distinct notes is counting rows
    notes = r.groupBy(*CELL, "cell", note).agg(F.count("*").alias("chunks"), F.sum("__chars").alias("chars"), F.sum("__tokens").alias("tokens"), F.count("__tokens").alias("known"))
    own = kept(notes.groupBy(*CELL, "cell").agg(F.count("*").alias("notes"), *[F.sum(c).alias(c) for c in ("chunks", "chars", "tokens", "known")]), "cells")
    users, cells = views_of(own, principals)
    summed = cells.join(own, "cell").groupBy("view").agg(*[F.sum(c).alias(c) for c in ("chunks", "notes", "chars", "tokens", "known")])
    return users.join(summed, "view").select("user", "chunks", "notes", "chars", "tokens", (F.col("tokens") / F.col("known")).alias("avg_tokens"))


def frequencies_as(rows: DataFrame, principals: DataFrame, asked: DataFrame, text: str = "text") -> DataFrame:
    """(user, term, df, tf) of the ``asked`` terms (user, term) over the rows (id, text, ...) that the user sees."""
    r = cells_of(rows)
    wanted = asked.select("term").distinct()
    said = r.select("cell", "id", F.explode(tokens(F.col(text))).alias("term"))
    counted = said.join(wanted, "term", "left_semi").groupBy("cell", "id", "term").agg(F.count("*").alias("tf"))
    per_cell = counted.groupBy("cell", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    users, cells = views_of(kept(r.select("cell", *CELL).dropDuplicates(["cell"]), "cells"), principals)
    by_view = asked.join(users, "user").select("view", "term").distinct()
    summed = per_cell.join(cells, "cell").join(by_view, ["view", "term"], "left_semi").groupBy("view", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    return asked.distinct().join(users, "user").join(summed, ["view", "term"]).select("user", "term", "df", "tf")


@dataclass(frozen=True)
class _Question:
    """What a pass knows of the questions of a block: term postings and vectors."""

    terms: list[np.ndarray]
    vectors: list[np.ndarray | None]


@dataclass(frozen=True)
class _View:
    """A view's part of a block: its questions and their pair numbers, mean length, idf by term, and postings term -> questions."""

    pairs: np.ndarray
    questions: np.ndarray
    mean: float
    idf: np.ndarray
    starts: np.ndarray
    posting: np.ndarray


def _parsed(rows: DataFrame, of: dict[str, int], embed: Callable | None) -> DataFrame:
    """(id, cell, n, terms, tfs, v): counts of asked terms, length (null for a null text), and the unit vector's doubles."""
    kind = dict(rows.dtypes)["id"]
    text_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(of)
    given = "embedding" in rows.columns

    def unit(vector) -> bytes | None:
        if vector is None or not len(vector):
            return None
        x = np.asarray(vector, dtype=np.float64)
        norm = np.linalg.norm(x)
        return (x / norm).tobytes() if norm > 0 else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for b in batches:
            out = []
            for i, text in enumerate(b["text"]):
                said = _TOKEN.findall(text.lower()) if text is not None else []
                found = [(index[t], n) for t, n in Counter(said).items() if t in index]
                vector = b["embedding"].iloc[i] if given else embed(said) if embed else None
                out.append((None if text is None else len(said), [t for t, _ in found], [n for _, n in found], unit(vector)))
            made = pd.DataFrame(out, columns=["n", "terms", "tfs", "v"])
            made["n"] = made["n"].astype("Int64")
            yield pd.concat([b[["id", "cell"]].reset_index(drop=True), made], axis=1)

    columns = ["id", "cell", "text", *(["embedding"] if given else [])]
    return rows.select(*columns).mapInPandas(parse, f"id {kind}, cell string, n long, terms array<int>, tfs array<int>, v binary")


def _legs(b: pd.DataFrame, views: list[_View], questions: _Question) -> Iterator[tuple[_View, np.ndarray, np.ndarray, np.ndarray]]:
    """(view, rows of ``b`` it sees, lexical, cosine) in whole millionths, questions by rows; ``b`` is sorted by id."""
    rows = len(b)
    sees = np.zeros((len(views), rows), dtype=bool)
    many = b["views"].map(len).to_numpy()
    sees[np.concatenate([np.asarray(v, dtype=np.int64) for v in b["views"]]), np.repeat(np.arange(rows), many)] = True
    counts = b["terms"].map(len).to_numpy()
    at = np.repeat(np.arange(rows), counts)
    flat = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in b[c]])
    term, tf = flat("terms"), flat("tfs").astype(np.float64)
    length = b["n"].fillna(0).to_numpy(dtype=np.float64)
    cos = np.zeros((len(questions.vectors), rows))
    held = [(len(v) if v is not None else 0) for v in b["v"]]
    for width in {w for w in held if w}:
        own = [i for i, w in enumerate(held) if w == width]
        asked = [i for i, v in enumerate(questions.vectors) if v is not None and v.nbytes == width]
        if asked:
            x = np.frombuffer(b"".join(b["v"].iloc[i] for i in own), dtype=np.float64).reshape(len(own), -1)
            cos[np.ix_(asked, own)] = np.stack([questions.vectors[i] for i in asked]) @ x.T
    for k, view in enumerate(views):
        seen = np.flatnonzero(sees[k])
        if not len(seen):
            continue
        place = np.full(rows, -1)
        place[seen] = np.arange(len(seen))
        use = (place[at] >= 0) & (view.idf[term] > 0)
        r, t, n = at[use], term[use], tf[use]
        scale = K1 * (1 - B + B * length[r] / view.mean) if view.mean else K1
        part = view.idf[t] * n * (K1 + 1) / (n + scale)
        fan = view.starts[t + 1] - view.starts[t]
        hit = np.repeat(np.arange(len(t)), fan)
        question = view.posting[np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + view.starts[t][hit]]
        shape = (len(view.questions), len(seen))
        lex = np.bincount(question * shape[1] + place[r][hit], weights=part[hit], minlength=shape[0] * shape[1]).reshape(shape)
        yield view, seen, _millionths(lex), _millionths(cos[view.questions][:, seen])


def _millionths(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero, as SQL does; a half that an addition's error has moved off counts as one."""
    return (np.sign(x) * np.floor(np.abs(x) * MILLION + 0.5 + 1e-7)).astype(np.int64)


def _ordered(score: np.ndarray, enters: np.ndarray) -> np.ndarray:
    """Numbers that fall along (score descending, place ascending); rows that do not enter are lowest."""
    return np.where(enters, score * score.shape[1] - np.arange(score.shape[1]), _LOWEST)


def _entering(lex: np.ndarray, cos: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, which rows enter): cosines up to ``least`` count as none, and a row enters with a positive score on either leg."""
    cos = np.where(cos > least, cos, 0)
    return cos, (lex > 0) | (cos > 0)


def _steps(batches: Iterator[pd.DataFrame], pairs: int) -> Iterator[pd.DataFrame]:
    step = max(1, BLOCK_SCORES // max(1, pairs))
    for b in batches:
        for start in range(0, len(b), step):
            yield b.iloc[start : start + step].sort_values("id").reset_index(drop=True)


def _first(held: pd.DataFrame, reach: int) -> pd.DataFrame:
    """The first ``reach`` rows of each pair on either leg."""
    keep = np.zeros(len(held), dtype=bool)
    for leg in ("lex", "cos"):
        order = held.sort_values(["pair", leg, "id"], ascending=[True, False, True]).index
        keep[order[held.loc[order].groupby("pair").cumcount() < reach]] = True
    return held[keep].reset_index(drop=True)


def _ends(held: pd.DataFrame, reach: int, pairs: int) -> dict[str, tuple[np.ndarray, list]]:
    """Per leg the score and the id of each pair's row at ``reach``; a pair with fewer rows has the lowest score."""
    out = {}
    for leg in ("lex", "cos"):
        order = held.sort_values(["pair", leg, "id"], ascending=[True, False, True])
        last = order[order.groupby("pair").cumcount() == reach - 1]
        scores, ids = np.full(pairs, _LOWEST), [None] * pairs
        scores[last["pair"].to_numpy()] = last[leg].to_numpy()
        for pair, i in zip(last["pair"].tolist(), last["id"].tolist()):
            ids[pair] = i
        out[leg] = scores, ids
    return out


def _above(score: np.ndarray, ids: np.ndarray, own: np.ndarray, ends: tuple[np.ndarray, list]) -> np.ndarray:
    """Which scores (pairs ``own`` by rows ``ids``) stand before the row at the end of what is held."""
    least = ends[0][own][:, None]
    before = score > least
    for q in np.flatnonzero((score == least).any(axis=1)):
        end = ends[1][own[q]]
        before[q] |= (score[q] == least[q]) & (ids < end)
    return before


def _candidates(table: DataFrame, views, questions, pairs: int, reach: int, least: int) -> DataFrame:
    """(pair, id, lex, cos): every row among the first ``reach`` of a leg, and some others."""
    sent = table.sparkSession.sparkContext.broadcast((views, questions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, parts, size, ends, most = sent.value, [], 0, None, HELD
        for b in _steps(batches, pairs):
            ids = b["id"].to_numpy()
            for view, seen, lex, cos in _legs(b, *known):
                cos, chosen = _entering(lex, cos, least)
                if ends:  # what stands below both ends cannot be among the first
                    chosen = chosen & (_above(lex, ids[seen], view.pairs, ends["lex"]) | _above(cos, ids[seen], view.pairs, ends["cos"]))
                if chosen.shape[1] > reach:
                    first = np.zeros_like(chosen)
                    for leg in (lex, cos):
                        key = _ordered(leg, chosen)
                        np.put_along_axis(first, np.argpartition(-key, reach - 1, axis=1)[:, :reach], True, axis=1)
                    chosen = chosen & first
                q, j = np.nonzero(chosen)
                parts.append(pd.DataFrame({"pair": view.pairs[q], "id": ids[seen[j]], "lex": lex[q, j], "cos": cos[q, j]}))
                size += len(q)
            if size > most:
                parts = [_first(pd.concat(parts, ignore_index=True), reach)]
                size = len(parts[0])
                ends, most = _ends(parts[0], reach, pairs), max(HELD, 2 * size)
        if size:
            yield _first(pd.concat(parts, ignore_index=True), reach)

    kind = dict(table.dtypes)["id"]
    return table.mapInPandas(run, f"pair long, id {kind}, lex long, cos long")


def _scores(table: DataFrame, views, questions, pairs: int, wanted: pd.DataFrame, least: int) -> DataFrame:
    """(pair, id, lex, cos) of the wanted rows (pair, id) that enter."""
    by_pair = {int(p): g["id"].to_numpy() for p, g in wanted.groupby("pair")}
    sent = table.sparkSession.sparkContext.broadcast((views, questions, by_pair))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views, questions, asked = sent.value
        for b in _steps(batches, pairs):
            ids = b["id"].to_numpy()
            for view, seen, lex, cos in _legs(b, views, questions):
                cos, enters = _entering(lex, cos, least)
                for i, pair in enumerate(view.pairs.tolist()):
                    j = np.flatnonzero(enters[i] & np.isin(ids[seen], asked.get(pair, [])))
                    if len(j):
                        yield pd.DataFrame({"pair": pair, "id": ids[seen[j]], "lex": lex[i, j], "cos": cos[i, j]})

    kind = dict(table.dtypes)["id"]
    return table.mapInPandas(run, f"pair long, id {kind}, lex long, cos long")


def _places(table: DataFrame, views, questions, pairs: int, candidates: pd.DataFrame, least: int) -> DataFrame:
    """(candidate, r1, r2): how many rows stand above each candidate on either leg."""
    order = np.argsort(candidates["pair"].to_numpy(), kind="stable")
    groups = {int(p): g for p, g in candidates.iloc[order].groupby("pair").indices.items()}
    by_pair = {p: (order[g], candidates["id"].to_numpy()[order[g]], candidates["lex"].to_numpy()[order[g]], candidates["cos"].to_numpy()[order[g]]) for p, g in groups.items()}
    sent = table.sparkSession.sparkContext.broadcast((views, questions, by_pair, len(candidates)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views, questions, wanted, n = sent.value
        above = np.zeros((2, n), dtype=np.int64)
        for b in _steps(batches, pairs):
            ids = b["id"].to_numpy()
            for view, seen, lex, cos in _legs(b, views, questions):
                cos, enters = _entering(lex, cos, least)
                keys = [np.sort(_ordered(leg, enters), axis=1) for leg in (lex, cos)]
                for i, pair in enumerate(view.pairs.tolist()):
                    if pair in wanted:
                        at, of, *scores = wanted[pair]
                        place = np.searchsorted(ids[seen], of)
                        for leg in range(2):
                            own = scores[leg] * len(seen) - place
                            above[leg, at] += len(seen) - np.searchsorted(keys[leg][i], own, side="right")
        some = np.flatnonzero(above.any(axis=0))
        yield pd.DataFrame({"candidate": some, "r1": above[0, some], "r2": above[1, some]})

    counted = table.mapInPandas(run, "candidate long, r1 long, r2 long")
    return counted.groupBy("candidate").agg(F.sum("r1").alias("r1"), F.sum("r2").alias("r2"))


def _views(pairs: pd.DataFrame, means: dict, idf: dict, questions: _Question, size: int) -> list[_View]:
    """The views of a block; ``pairs``: (pair, view, question)."""
    out = []
    for view, own in pairs.groupby("view", sort=True):
        asked = own["question"].to_numpy()
        weights = np.zeros(size)
        for term, weight in idf.get(view, ()):
            weights[term] = weight
        lists = [questions.terms[q] for q in asked]
        term = np.concatenate([*lists, np.array([], dtype=np.int64)]).astype(np.int64)
        of = np.repeat(np.arange(len(asked)), [len(x) for x in lists])
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))]).astype(np.int64)
        out.append(_View(own["pair"].to_numpy(), asked, means.get(view, 0.0), weights, starts, of[order]))
    return out


def search_views(rows: DataFrame, cells: DataFrame, queries: DataFrame, asks: DataFrame, k: int, least: float = 0.0, vectors: DataFrame | None = None, embed: Callable | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(view, qid, id, lex, cos, score, rank): the first ``k`` rows of each asked pair, or of the ``wanted`` rows (view, qid, id)
    alone, whose lex, cos and score are those that they have among all rows.

    ``rows``: (id, cell, text) with ``embedding`` in the same frame, in ``vectors`` (id, embedding), or made by ``embed`` from a text's tokens;
    ``cells``: (view, cell); ``queries``: (qid, text, embedding?); ``asks``: (view, qid).
    """
    first = queries.limit(QUESTIONS + 1).toPandas()
    groups = 1 if len(first) <= QUESTIONS else -(-queries.count() // QUESTIONS)
    found = None
    for g in range(groups):
        own = first if groups == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g).toPandas()
        part = _search_group(rows, cells, own, asks, k, least, vectors, embed, wanted)
        found = part if found is None else found.unionByName(part)
    return found


def _search_group(rows, cells, asked: pd.DataFrame, asks, k, least, vectors, embed, wanted) -> DataFrame:
    spark = rows.sparkSession
    kinds = {c: dict(f.dtypes)[c] for c, f in (("qid", asks), ("id", rows), ("view", asks))}
    said = [list(dict.fromkeys(_TOKEN.findall((t or "").lower()))) for t in asked["text"]]
    of = {t: i for i, t in enumerate(dict.fromkeys(t for ts in said for t in ts))}

    def vector(i: int):
        v = asked["embedding"].iloc[i] if "embedding" in asked else embed(_TOKEN.findall((asked["text"].iloc[i] or "").lower())) if embed else None
        norm = 0.0 if v is None else np.linalg.norm(np.asarray(v, dtype=np.float64))
        return np.asarray(v, dtype=np.float64) / norm if norm > 0 else None

    questions = _Question([np.array([of[t] for t in ts], dtype=np.int64) for ts in said], [vector(i) for i in range(len(asked))])
    numbered = spark.createDataFrame(pd.DataFrame({"qid": asked["qid"], "question": range(len(asked))}), f"qid {kinds['qid']}, question long") if len(asked) else None
    empty = spark.createDataFrame([], f"view {kinds['view']}, qid {kinds['qid']}, id {kinds['id']}, lex double, cos double, score double, rank int")
    if numbered is None:
        return empty
    pairs = asks.join(numbered, "qid").select("view", "question").distinct().toPandas()  # what is asked, two numbers a pair
    parsed = _parsed(rows, of, embed)
    if vectors is not None:
        packed = _parsed(vectors.select("id", F.lit(None).cast("string").alias("cell"), F.lit(None).cast("string").alias("text"), "embedding"), {}, None)
        parsed = parsed.drop("v").join(packed.select("id", "v"), "id", "left")
    # a row that no asked view sees is left behind here
    needed = sorted(pairs["view"].unique())
    names = spark.createDataFrame([(v, i) for i, v in enumerate(needed)], f"view {kinds['view']}, number int")
    shown = kept(cells.join(names, "view").groupBy("cell").agg(F.collect_list("number").alias("numbers")), "shown")
    table = kept(parsed.join(shown, "cell"), "parsed")
    per_cell = table.groupBy("cell").agg(F.count("*").alias("n"), F.count("n").alias("known"), F.sum("n").alias("total"))
    sums = per_cell.join(shown, "cell").select("*", F.explode("numbers").alias("view")).groupBy("view").agg(*[F.sum(c).alias(c) for c in ("n", "known", "total")])
    stats = {r["view"]: r for r in sums.collect()}  # a row per view of the group
    means = {v: (r["total"] or 0) / max(1, r["known"]) for v, r in stats.items()}
    dfs = table.select("cell", F.explode("terms").alias("term")).groupBy("cell", "term").agg(F.count("*").alias("df"))
    by_view = dfs.join(shown, "cell").select("term", "df", F.explode("numbers").alias("view")).groupBy("view", "term").agg(F.sum("df").alias("df"))
    rest = pairs.assign(view=pairs["view"].map({v: i for i, v in enumerate(needed)})).sort_values(["view", "question"])
    words = pd.DataFrame({"question": np.repeat(np.arange(len(said)), [len(t) for t in questions.terms]), "term": np.concatenate([*questions.terms, np.array([], dtype=np.int64)]).astype(np.int64)})
    found, done = None, [table, shown]
    for start in range(0, len(rest), PAIRS):
        block = rest.iloc[start : start + PAIRS].reset_index(drop=True)
        block["pair"] = np.arange(len(block))
        local = {v: i for i, v in enumerate(sorted(block["view"].unique()))}
        inside = F.array(*[F.lit(int(v)) for v in local])
        asked_terms = block[["view", "question"]].merge(words, on="question")[["view", "term"]].drop_duplicates()
        block_terms = spark.createDataFrame(asked_terms.astype({"view": "int32", "term": "int32"}), "view int, term int")
        idf: dict = {}
        in_block = by_view if len(needed) == 1 else by_view.join(block_terms, ["view", "term"])
        for r in in_block.collect():  # a row per view and asked term of the block
            if r["df"] < stats[r["view"]]["n"]:
                idf.setdefault(r["view"], []).append((r["term"], float(np.log(stats[r["view"]]["n"] / r["df"]))))
        views = _views(block, means, idf, questions, len(of))
        to_local = F.create_map(*[F.lit(int(x)) for pair in local.items() for x in pair])
        seen = F.transform(F.array_intersect("numbers", inside), lambda v: F.element_at(to_local, v))
        own = table.select("id", "n", "terms", "tfs", "v", seen.alias("views")).where(F.size("views") > 0)
        reach = RRF_K + 2 * k
        floor = int(np.floor(max(least, 0.0) * MILLION))
        by = Window.partitionBy("pair")
        labels = pd.DataFrame({"pair": block["pair"], "view": [needed[v] for v in block["view"]], "qid": asked["qid"].to_numpy()[block["question"]]})
        named_pairs = F.broadcast(spark.createDataFrame(labels, f"pair long, view {kinds['view']}, qid {kinds['qid']}"))
        if wanted is None:
            met = _candidates(own, views, questions, len(block), reach, floor)
            for leg, rank in (("lex", "c1"), ("cos", "c2")):
                met = met.withColumn(rank, F.row_number().over(by.orderBy(F.desc(leg), "id")))
            first = met.where(F.least("c1", "c2") <= reach).drop("c1", "c2").toPandas()  # at most 2 * reach rows a pair
        else:
            chosen = wanted.join(named_pairs, ["view", "qid"]).select("pair", "id").distinct().toPandas()
            first = _scores(own, views, questions, len(block), chosen, floor).toPandas()
        first["candidate"] = np.arange(len(first))
        places = _places(own, views, questions, len(block), first, floor)
        given = spark.createDataFrame(first, f"pair long, id {kinds['id']}, lex long, cos long, candidate long")
        share = lambda c: F.lit(1.0) / (RRF_K + F.coalesce(c, F.lit(0)))
        scored = given.join(places, "candidate", "left").withColumn("score", share("r1") + share("r2"))
        rank = (F.row_number().over(by.orderBy(F.desc("score"), "id")) - 1).cast("int")
        best = scored.withColumn("rank", rank).where(F.col("rank") < k)
        named = best.join(named_pairs, "pair")
        part = kept(named.select("view", "qid", "id", (F.col("lex") / MILLION).alias("lex"), (F.col("cos") / MILLION).alias("cos"), "score", "rank"), "found")
        found = part if found is None else found.unionByName(part)
    for frame in done:
        drop_kept(frame)
    return empty if found is None else found


def hybrid_search(rows: DataFrame, queries: DataFrame, k: int = 8, least: float = 0.0, vectors: DataFrame | None = None, embed: Callable | None = None) -> DataFrame:
    """(qid, id, lex, cos, score, rank): the first ``k`` rows of each question, for one reader who sees all ``rows``."""
    spark = rows.sparkSession
    everything = spark.createDataFrame([("", "")], "view string, cell string")
    asks = queries.select(F.lit("").alias("view"), "qid")
    return search_views(rows.withColumn("cell", F.lit("")), everything, queries, asks, k, least, vectors, embed).drop("view")


def first_notes(rows: DataFrame, queries: DataFrame, k: int, embed: Callable | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(first, more): for each question the best row of each of its first ``k`` notes (qid, id, note, score, place), and, for
    questions that have fewer notes, the next ``2k + 9`` other rows (likewise, places go on).

    A note with many rows can hold back others, so questions that are not served by their first rows look at four times as many.
    """
    notes = rows.select("id", "note")
    found, rest, reach = None, queries, 4 * k
    while True:
        hits = hybrid_search(rows.drop("note"), rest, reach, vectors=vectors, embed=embed).join(notes, "id")
        own = F.row_number().over(Window.partitionBy("qid", "note").orderBy("rank"))
        hits = kept(hits.withColumn("again", own > 1), "hits")
        served = hits.groupBy("qid").agg(F.count_if(~F.col("again")).alias("notes"), F.count("*").alias("n")).withColumn("open", (F.col("notes") < k) & (F.col("n") == reach))
        open_ = served.where("open").select("qid")
        done = hits.join(open_, "qid", "left_anti")
        found = done if found is None else found.unionByName(done)
        if open_.isEmpty():
            break
        rest, reach = rest.join(open_, "qid", "left_semi"), 4 * reach
    place = F.row_number().over(Window.partitionBy("qid", "again").orderBy("rank"))
    placed = kept(found.withColumn("place", place), "placed")
    first = placed.where(~F.col("again") & (F.col("place") <= k))
    short = first.groupBy("qid").agg(F.count("*").alias("notes")).where(F.col("notes") < k)
    more = placed.where(F.col("again") & (F.col("place") <= 2 * k + 9)).join(short, "qid").withColumn("place", F.col("place") + F.col("notes"))
    columns = ["qid", "id", "note", "score", "place"]
    return first.select(*columns), more.select(*columns)


#: Results that are widened by their note's best chunks, and chunks of a note that such a passage draws on.
MERGED_HITS, MERGED_CHUNKS = 3, 3
GAP = "[…]"


def merged_passages(chunks: DataFrame, queries: DataFrame, k: int = 8, embed: Callable | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, place, note, chunk_idx, score, passage): what a question is answered with, at most ``k`` passages.

    ``chunks``: (id, note, chunk_idx, text), id in corpus order. The best chunk of each note comes first, then further chunks. The first three
    passages hold their note's three best chunks and the hit's neighbours, in document order with gaps marked; what a passage holds
    does not come again. The order of a note's chunks is that of the whole fused ranking.
    """
    first, more = first_notes(chunks.select("id", "note", "text"), queries, k, embed, vectors)
    first, more = kept(first, "first"), kept(more, "more")
    tops = first.where(F.col("place") <= MERGED_HITS).select("qid", "note", F.col("id").alias("hit"))
    # when there are few notes, a further chunk can be among the first three
    tops = tops.unionByName(more.where(F.col("place") <= MERGED_HITS + 2 * k + 9).join(first.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") < MERGED_HITS), "qid").select("qid", "note", F.col("id").alias("hit")))
    pieces = chunks.select("note", "chunk_idx", "id")
    asked = tops.select("qid", "note").distinct().join(pieces, "note").select(F.lit("").alias("view"), "qid", "id")
    everything = chunks.sparkSession.createDataFrame([("", "")], "view string, cell string")
    ranked = search_views(
        chunks.select("id", "text", F.lit("").alias("cell")), everything, queries, asked.select("view", "qid").distinct(), 1 << 30, 0.0, vectors, embed, wanted=asked
    ).join(chunks.select("id", "note", "chunk_idx"), "id")
    order = F.row_number().over(Window.partitionBy("qid", "note").orderBy(F.desc("score"), "id"))
    # hit + two others are among the note's first three or the hit itself
    best = ranked.withColumn("r", order).where(F.col("r") <= MERGED_CHUNKS).select("qid", "note", "chunk_idx", "r")
    chosen = first.unionByName(more).join(chunks.select("id", "chunk_idx"), "id")
    of_note = best.groupBy("qid", "note").agg(F.sort_array(F.collect_list(F.struct("r", "chunk_idx"))).alias("best"))
    near = pieces.groupBy("note").agg(F.max("chunk_idx").alias("last"))
    kinds = dict(chosen.dtypes)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        covered, out = set(), []
        for r in group.sort_values("place").itertuples():
            if len(out) >= k:
                break
            if (r.note, r.chunk_idx) in covered:
                continue
            wanted = {r.chunk_idx}
            if len(out) < MERGED_HITS:
                for b in r.best if r.best is not None else ():
                    if len(wanted) < MERGED_CHUNKS:
                        wanted.add(b["chunk_idx"])
                wanted |= {r.chunk_idx - 1, r.chunk_idx + 1}
            wanted = sorted(i for i in wanted if 0 <= i <= r.last)
            covered |= {(r.note, i) for i in wanted}
            out.append((r.qid, len(out) + 1, r.note, r.chunk_idx, r.score, wanted))
        return pd.DataFrame(out, columns=["qid", "place", "note", "chunk_idx", "score", "parts"])

    rows = chosen.join(of_note, ["qid", "note"], "left").join(near, "note").select("qid", "note", "chunk_idx", "score", "place", "best", "last")
    picked = rows.groupBy("qid").applyInPandas(choose, f"qid {kinds['qid']}, place int, note {kinds['note']}, chunk_idx int, score double, parts array<int>")
    each = picked.select("*", F.explode("parts").alias("part"))
    said = each.join(chunks.select("note", F.col("chunk_idx").alias("part"), "text"), ["note", "part"])
    before = F.lag("part").over(Window.partitionBy("qid", "place").orderBy("part"))
    piece = F.when(F.col("part") - before > 1, F.concat(F.lit(GAP + "\n"), "text")).otherwise(F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "piece")))
    whole = said.withColumn("piece", piece).groupBy("qid", "place", "note", "chunk_idx", "score")
    return whole.agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("passage"))


def search_as(
    rows: DataFrame, queries: DataFrame, asks: DataFrame, principals: DataFrame, k: int = 8, least: float = 0.0, vectors: DataFrame | None = None, embed: Callable | None = None
) -> DataFrame:
    """(user, qid, id, lex, cos, score, rank): what each principal's questions (``asks``: user, qid) find among the rows that the principal may see.

    ``rows``: (id, text, space, private, untrusted, readers); ``principals``: (user, spaces, include_private, trusted_only).
    A user whom no principal row names, or who sees nothing, finds nothing.
    """
    r = cells_of(rows)
    users, cells = views_of(kept(r.select("cell", *CELL).dropDuplicates(["cell"]), "cells"), principals)
    asked = asks.join(users, "user")
    found = search_views(r, cells, queries, asked.select("view", "qid").distinct(), k, least, vectors, embed)
    return asked.select("user", "view", "qid").distinct().join(found, ["view", "qid"]).select("user", "qid", "id", "lex", "cos", "score", "rank")
