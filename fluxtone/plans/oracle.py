"""Pieces of DuckDB SQL that the queries' oracles share: the signal views and folds as recursive queries."""

from __future__ import annotations

FRAMES = "select vec_id as id, list_transform(embedding, lambda s: s::double) as x, label from embeddings"
PCM = "select vec_id as id, list_transform(embedding, lambda s: trunc(s::double * 32767)::int) as v, label from embeddings"
SERIES = "select user_id as stream, event_id as seq, ts as t, value / 1000 as x from events"
PACKETS = "select conv_id as ssrc, turn as seq, role = 'assistant' as marker, text from conversations"
LOSSY = f"""select * from (select stream, row_number() over (partition by stream order by seq) as seq, x from ({SERIES})) where seq % 10 <> 3
  union all select * from (select stream, row_number() over (partition by stream order by seq) as seq, x from ({SERIES})) where seq % 10 <> 3 and seq % 17 = 5"""
CORRELATED = f"""select id, n, sum(v) over (partition by id order by n)::bigint // 64 as v from (
  select id, n, sum(v) over (partition by id order by n)::bigint // 64 as v from (
  select id, unnest(v)::bigint as v, generate_subscripts(v, 1) - 1 as n from ({PCM})))"""


def fold(source: str, values: str, start: dict[str, str], lets: list[tuple[str, str]], new: dict[str, str]) -> str:
    """A row (id, i, state...) for each step of a fold over the list ``values`` of ``source``; s is the value, state fields are p_name.

    ``lets`` are named one after another and may use those before.
    """
    state = ", ".join(f"{v} as p_{k}" for k, v in start.items())
    chain = "select r.*, list_extract(f.{0}, r.i + 1) as s from r join f using (id) where r.i < len(f.{0})".format(values)
    for name, what in lets:
        chain = f"select *, {what} as {name} from ({chain})"
    return f"""with recursive f as ({source}), r as (
  select id, 0 as i, {state} from f
  union all select id, i + 1, {", ".join(new[k] for k in start)} from ({chain}))"""


def array(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def registry() -> tuple[dict, dict, object]:
    """A module's queries, their SQL, and the decorator that adds a query with its SQL to both."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
