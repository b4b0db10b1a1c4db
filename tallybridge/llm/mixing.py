"""Mixing sources to target weights: budgets down a tree, then token prefixes of epochs.

The tree is domain, language, source. A node can supply at most ``MAX_EPOCHS`` times the
tokens below it. From the root down, a node's budget is shared among its children by
weight; what a child cannot supply goes to its siblings by their weights, and only what
all of them lack is missing at the level above, where the same rule has shared it out.
Shares are whole tokens by largest remainder, so budgets add up exactly.

A leaf's budget buys whole epochs and then a prefix of one more: its documents in the
order of ``md5(seed:epoch:id)`` up to the last that fits. The prefix is found from token
sums of 256 slices of that order, then of 256 slices of the one where it ends, and so on
until that holds no more than ``SLICE_PLACES`` places, which are then gone through one by
one. Documents of one place are added up first, so neither a leaf nor an id of any size
comes into one task. The prefix comes out as one hash per leaf, so that documents are only
compared with their leaf's row.

Everything is SQL functions, joins and aggregates.

Cases: NULL or empty domains, languages and sources are nodes of their own, as
``unknown``; NULL and blank texts have no tokens, and go where their place in the order
lies; rows that repeat an id share a place and go together; a weight that is not given
counts 1; with no tokens nothing is selected; an empty table gives no rows; clashing extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallybridge.functions.sqltext import listed, query
from tallybridge.workspace import Workspace

SEED = 17
MAX_EPOCHS = 3
# Tokens of the mixture per 100 tokens of the corpus.
BUDGET_PERCENT = 60
# Places of a leaf that one task may go through in order.
SLICE_PLACES = 100_000
# Weights of production; a domain is a group of sources.
DOMAINS = 4
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}

# Both engines know these; Java's pattern needs the tab and return spelled the same way.
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
DOMAIN = f"concat('d', CAST(coalesce(CAST(nullif(regexp_extract(source, '([0-9])$', 1), '') AS INT), 0) % {DOMAINS} AS STRING))"


def _named(column: str) -> str:
    return f"coalesce(nullif(CAST({column} AS STRING), ''), 'unknown')"


def weight_case(column: str, weights: Mapping[str, int]) -> str:
    cases = "".join(f" WHEN '{name}' THEN {int(weight)}" for name, weight in weights.items())
    return f"CASE {column}{cases} ELSE 1 END" if cases else "1"


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight``, none beyond ``cap``.

    Children in the order of cap over weight: those before the level at which the rest
    of the budget meets the rest of the weights are filled to their caps.
    """
    by = f"PARTITION BY {listed(parent)}" if parent else "PARTITION BY 1"
    order = f"{by} ORDER BY CAST(cap AS DOUBLE) / weight, {name}"
    marked = query(
        f"""
        SELECT *, cap * rest_weight <= weight * greatest(budget - cap_before, 0) AS filled
        FROM (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
                     sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
              FROM {{children}})
        """,
        children=children,
    )
    shared = query(
        f"""
        SELECT *, CASE WHEN filled THEN cap ELSE CAST((weight * room) div open_weight AS DECIMAL(38, 0)) END AS whole,
               CASE WHEN filled THEN 0 ELSE (weight * room) % open_weight END AS part
        FROM (SELECT *, greatest(budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by}), 0), 0) AS room,
                     sum(CASE WHEN NOT filled THEN weight END) OVER ({by}) AS open_weight
              FROM {{marked}})
        """,
        marked=marked,
    )
    return query(
        f"""
        SELECT * EXCEPT (budget, cap_before, rest_weight, filled, room, open_weight, whole, part, extra, place),
               whole + CASE WHEN NOT filled AND place <= extra THEN 1 ELSE 0 END AS budget
        FROM (SELECT *, CASE WHEN open_weight IS NULL THEN 0 ELSE room - sum(CASE WHEN filled THEN 0 ELSE whole END) OVER ({by}) END AS extra,
                     row_number() OVER ({by} ORDER BY part DESC, {name}) AS place
              FROM {{shared}})
        """,
        shared=shared,
    )


def narrow(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """What the plan needs of every document: its id, its leaf and its tokens."""
    return query(
        f"""
        SELECT CAST(doc_id AS BIGINT) AS doc_id, {_named(domain)} AS domain, {_named('lang')} AS lang,
               {_named('source')} AS source, CAST(coalesce(regexp_count(text, '{WORD}'), 0) AS BIGINT) AS n_tokens
        FROM {{docs}}
        """,
        docs=docs,
    )


def place(epoch: str) -> str:
    return f"md5(CAST(concat('{SEED}:', CAST({epoch} AS STRING), ':', coalesce(CAST(doc_id AS STRING), '')) AS BINARY))"


def prefixes(placed: DataFrame, workspace: Workspace, most: int = SLICE_PLACES) -> DataFrame:
    """``domain, lang, source, cut``: the last place up to which a leaf's tokens are within its ``rest``.

    ``placed`` has ``domain, lang, source, rest, place, n_tokens``; leaves whose first place
    is too much already have no row.
    """
    inside = query("SELECT *, CAST(0 AS BIGINT) AS before FROM {placed}", placed=placed)
    cuts = []
    for digits in range(2, 33, 2):
        slices = workspace.store(
            query(
                f"""
                SELECT *, before + sum(n) OVER (PARTITION BY domain, lang, source ORDER BY slice) AS upto
                FROM (SELECT domain, lang, source, rest, before, substr(place, 1, {digits}) AS slice,
                             sum(n_tokens) AS n, max(place) AS last
                      FROM {{inside}} GROUP BY domain, lang, source, rest, before, substr(place, 1, {digits}))
                """,
                inside=inside,
            ),
            "slices",
        )
        cuts.append(query("SELECT domain, lang, source, last AS cut FROM {slices} WHERE upto <= rest", slices=slices))
        # Every slice from here on is smaller than the one it is part of.
        ending = query(
            "SELECT domain, lang, source, slice, upto - n AS start FROM {slices} WHERE upto > rest AND upto - n <= rest",
            slices=slices,
        )
        inside = workspace.store(
            query(
                f"""
                SELECT p.domain, p.lang, p.source, p.rest, place, sum(n_tokens) AS n_tokens, start AS before
                FROM {{inside}} p JOIN {{ending}} e
                ON p.domain = e.domain AND p.lang = e.lang AND p.source = e.source AND substr(p.place, 1, {digits}) = e.slice
                GROUP BY p.domain, p.lang, p.source, p.rest, place, start
                """,
                inside=inside,
                ending=ending,
            ),
            "inside",
        )
        largest = query(
            "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {inside} GROUP BY domain, lang, source)", inside=inside
        ).head()["n"]
        if (largest or 0) <= most:
            break
    cuts.append(
        query(
            """
            SELECT domain, lang, source, place AS cut
            FROM (SELECT *, before + sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM {inside})
            WHERE upto <= rest
            """,
            inside=inside,
        )
    )
    return reduce(DataFrame.unionAll, cuts).groupBy("domain", "lang", "source").agg(F.max("cut").alias("cut"))


def plan(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """A row per leaf: tokens, budget, whole epochs, and the last place of the next epoch's prefix."""
    keys = ["domain", "lang", "source"]
    leaves = query(
        f"""
        SELECT domain, lang, source, CAST(sum(n_tokens) AS DECIMAL(38, 0)) AS tokens,
               CAST(sum(n_tokens) * {MAX_EPOCHS} AS DECIMAL(38, 0)) AS cap
        FROM {{rows}} GROUP BY domain, lang, source
        """,
        rows=rows,
    )
    total = query(f"SELECT (sum(tokens) * {BUDGET_PERCENT}) div 100 AS budget FROM {{leaves}}", leaves=leaves)
    weights = {
        "domain": weight_case("domain", DOMAIN_WEIGHTS),
        "lang": weight_case("lang", LANGUAGE_WEIGHTS),
        "source": "1",
    }
    above = query("SELECT CAST(budget AS DECIMAL(38, 0)) AS budget FROM {total}", total=total)
    for depth, name in enumerate(keys):
        path, parent = keys[: depth + 1], keys[:depth]
        nodes = query(
            f"""
            SELECT {listed(path)}, sum(cap) AS cap, CAST({weights[name]} AS DECIMAL(9, 0)) AS weight
            FROM {{leaves}} GROUP BY {listed(path)}
            """,
            leaves=leaves,
        )
        # One row stands above the domains.
        joined = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above), F.lit(True))
        shared = share(joined, parent, name)
        above = query(f"SELECT {listed(path)}, budget FROM {{shared}}", shared=shared)
    bought = workspace.store(
        query(
            f"""
            SELECT domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(budget AS BIGINT) AS budget,
                   CAST(CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END AS BIGINT) AS epochs,
                   CAST(CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS BIGINT) AS rest
            FROM {{leaves}} JOIN {{above}} USING (domain, lang, source)
            """,
            leaves=leaves,
            above=above,
        ),
        "budgets",
    )
    placed = query(
        f"""
        SELECT domain, lang, source, rest, n_tokens, {place('epochs + 1')} AS place
        FROM {{rows}} JOIN {{bought}} USING (domain, lang, source)
        """,
        rows=rows,
        bought=bought,
    )
    return bought.join(prefixes(placed, workspace), keys, "left")


def copies(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """``doc_id``, the leaf, its budget, ``n_tokens`` and how often the mixture has the document."""
    workspace = Workspace(docs.sparkSession)
    rows = workspace.store(narrow(docs, domain), "tokens")
    leaves = workspace.store(plan(rows, workspace), "plan")
    return query(
        f"""
        SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
               CAST(CASE WHEN budget = 0 THEN 0 ELSE epochs + CASE WHEN {place('epochs + 1')} <= cut THEN 1 ELSE 0 END END AS INT) AS copies
        FROM {{rows}} JOIN {{leaves}} USING (domain, lang, source)
        """,
        rows=rows,
        leaves=leaves,
    )


def mix(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as its leaf's budget buys it."""
    workspace = Workspace(docs.sparkSession)
    rows = workspace.store(narrow(docs, domain), "tokens")
    leaves = workspace.store(plan(rows, workspace), "plan").select(
        *[F.col(c).alias(f"_mix_{c}") for c in ("domain", "lang", "source", "budget", "epochs", "cut")]
    )
    # Columns under names of their own, so that none of the input's can clash.
    read = ["doc_id", "lang", "source"]
    inner = {c: c if c in read else f"_in{i}" for i, c in enumerate(docs.columns)}
    here = docs.select(
        *[F.col("`" + c.replace("`", "``") + "`").alias(name) for c, name in inner.items()],
        *[F.expr(_named(e)).alias(f"_at_{n}") for n, e in (("domain", domain), ("lang", "lang"), ("source", "source"))],
    )
    joined = here.join(leaves, F.expr("_at_domain = _mix_domain AND _at_lang = _mix_lang AND _at_source = _mix_source"))
    often = f"CASE WHEN _mix_budget = 0 THEN 0 ELSE _mix_epochs + CASE WHEN {place('_mix_epochs + 1')} <= _mix_cut THEN 1 ELSE 0 END END"
    return (
        joined.withColumn("_often", F.expr(f"CAST({often} AS INT)"))
        .where("_often > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_often"))))
        .select(*inner.values()).toDF(*inner)
    )


def _oracle() -> str:
    """The same rule stated plainly for DuckDB: one running sum over each leaf."""

    def level(out: str, nodes: str, parent: list[str], path: list[str]) -> str:
        by = f"PARTITION BY {listed(parent)}" if parent else ""
        name = path[-1]
        return f"""
        {out}_a AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
            sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
            FROM ({nodes}) WINDOW w AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {name})),
        {out}_b AS (SELECT *, cap * rest_weight <= weight * greatest(budget - cap_before, 0) AS filled FROM {out}_a),
        {out}_c AS (SELECT *, greatest(budget - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0), 0) AS room,
            sum(weight) FILTER (NOT filled) OVER ({by}) AS open_weight FROM {out}_b),
        {out}_d AS (SELECT *, CASE WHEN filled THEN cap ELSE (weight * room) // open_weight END AS whole,
            CASE WHEN filled THEN 0 ELSE (weight * room) % open_weight END AS part FROM {out}_c),
        {out}_e AS (SELECT *, room - sum(CASE WHEN filled THEN 0 ELSE whole END) OVER ({by}) AS extra,
            row_number() OVER ({by} ORDER BY part DESC, {name}) AS place FROM {out}_d),
        {out} AS (SELECT {listed(path)}, whole + CASE WHEN NOT filled AND place <= extra THEN 1 ELSE 0 END AS budget FROM {out}_e)"""

    named = lambda c: f"coalesce(nullif(CAST({c} AS VARCHAR), ''), 'unknown')"
    domain = f"concat('d', coalesce(CAST(nullif(regexp_extract(source, '([0-9])$', 1), '') AS INT), 0) % {DOMAINS})"
    nodes = lambda path, weight, above, join: (
        f"SELECT {listed(path)}, cap, weight, budget FROM (SELECT {listed(path)}, sum(cap) AS cap, CAST({weight} AS HUGEINT) AS weight "
        f"FROM leaves GROUP BY {listed(path)}) {join} {above}"
    )
    return f"""
    WITH rows AS (SELECT doc_id, {named(domain)} AS domain, {named('lang')} AS lang, {named('source')} AS source,
            CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens,
            CAST(sum(n_tokens) * {MAX_EPOCHS} AS HUGEINT) AS cap FROM rows GROUP BY ALL),
        top AS (SELECT CAST(sum(tokens) * {BUDGET_PERCENT} AS HUGEINT) // 100 AS budget FROM leaves),
        {level('l1', nodes(['domain'], weight_case('domain', DOMAIN_WEIGHTS), 'top', 'CROSS JOIN'), [], ['domain'])},
        {level('l2', nodes(['domain', 'lang'], weight_case('lang', LANGUAGE_WEIGHTS), 'l1 USING (domain)', 'JOIN'), ['domain'], ['domain', 'lang'])},
        {level('l3', nodes(['domain', 'lang', 'source'], '1', 'l2 USING (domain, lang)', 'JOIN'), ['domain', 'lang'], ['domain', 'lang', 'source'])},
        bought AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS budget,
            CAST(CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS BIGINT) AS epochs,
            CAST(CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS BIGINT) AS rest FROM leaves JOIN l3 USING (domain, lang, source)),
        placed AS (SELECT *, md5(concat('{SEED}:', epochs + 1, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place
            FROM rows JOIN bought USING (domain, lang, source)),
        summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM placed)
    SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
        CAST(CASE WHEN budget = 0 THEN 0 ELSE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END END AS INT) AS copies FROM summed
    """


ORACLE = _oracle()
