"""Named views of the SQL oracles (DuckDB dialect)."""

from __future__ import annotations

EPSILON = 0.01
SEED = 7


def uniform(*parts: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '{seed}')), 1, 8))::BIGINT / 4294967296.0)"


def keep(k: str, epsilon: float = EPSILON) -> str:
    return f"(1 - pow({epsilon}, 1.0 / ({k} - 1)))"


def coin_pairs(rows: str, group: str, member: str, condition: str = "TRUE", seed: int = SEED) -> str:
    """The coin form of the sampler: Poisson darts of each member at the later members of its block.

    The number of darts is the place of a uniform number in the Poisson distribution of the member's rate.
    """
    keys = [key.strip() for key in group.split(",")]
    return f"""WITH placed AS (SELECT {group}, {member}, row_number() OVER (PARTITION BY {group} ORDER BY {member}) - 1 AS i,
      count(*) OVER (PARTITION BY {group}) AS k FROM {rows}),
    rated AS (SELECT *, row_number() OVER () AS id, -(k - 1 - i) * ln(1 - {keep('k')}) AS rate,
      {uniform(member, *keys, seed=seed)} AS u FROM placed WHERE i < k - 1 AND {condition}),
    reached AS (SELECT id, u, sum(exp(-rate + n * ln(rate) - lgamma(n + 1))) OVER (PARTITION BY id ORDER BY n) AS mass
      FROM rated, range(64) steps(n)),
    thrown AS (SELECT id, count(*) AS darts FROM reached WHERE mass <= u GROUP BY id),
    aimed AS (SELECT DISTINCT {group}, {member} AS e1,
      i + 1 + CAST(floor({uniform(member, *keys, 'dart', seed=seed + 1)} * (k - 1 - i)) AS BIGINT) AS i
      FROM rated JOIN thrown USING (id), unnest(range(1, darts + 1)) hits(dart))
    SELECT {group}, e1, placed.{member} AS e2 FROM aimed JOIN placed USING ({group}, i)"""


def counted_pairs(rows: str, group: str, member: str, condition: str = "TRUE", seed: int = SEED) -> str:
    """The fixed-count form: drawn pair numbers without repeats, the quota of smallest hash."""
    keys = [key.strip() for key in group.split(",")]
    return f"""WITH placed AS (SELECT {group}, {member}, row_number() OVER (PARTITION BY {group} ORDER BY {member}) - 1 AS i,
      count(*) OVER (PARTITION BY {group}) AS k FROM {rows}),
    blocks AS (SELECT DISTINCT {group}, k, k * (k - 1) // 2 AS pairs, {keep('k')} AS p FROM placed WHERE {condition}),
    quotas AS (SELECT *, ceil(pairs * p) AS quota, CAST(ceil(-pairs * ln(1 - p) + 12 * sqrt(ceil(pairs * p)) + 64) AS BIGINT) AS draws FROM blocks),
    drawn AS (SELECT DISTINCT {group}, quota, least(pairs - 1, CAST(floor(({uniform(*keys, 'draw', seed=seed)}
      + {uniform(*keys, 'draw', seed=seed + 1)} / 4294967296.0) * pairs) AS BIGINT)) AS number
      FROM quotas, unnest(range(draws)) tries(draw)),
    kept AS (SELECT *, CAST(floor((1 + sqrt(1 + 8 * number)) / 2) AS BIGINT) AS j FROM drawn
      QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {uniform(*keys, 'number', seed=seed + 2)}, number) <= quota)
    SELECT {', '.join(f'kept.{key}' for key in keys)}, a.{member} AS e1, b.{member} AS e2 FROM kept
      JOIN placed a ON {' AND '.join(f'a.{key} = kept.{key}' for key in keys)} AND a.i = number - j * (j - 1) // 2
      JOIN placed b ON {' AND '.join(f'b.{key} = kept.{key}' for key in keys)} AND b.i = j"""


# name -> (views it reads, text)
VIEWS: dict[str, tuple[str, str]] = {
    "edits": (
        "",
        """SELECT l_orderkey * 10 + l_linenumber AS rev_id, l_partkey AS article_id,
          CASE WHEN o_custkey % 10 = 0 THEN concat('ip:', CAST(o_custkey AS VARCHAR))
               ELSE CAST(o_custkey AS VARCHAR) END AS user_id,
          CASE WHEN o_custkey % 17 = 0 THEN concat(c_name, 'Bot') ELSE c_name END AS username,
          p_type AS category, l_shipdate AS "timestamp", l_returnflag = 'R' AS minor,
          CAST(floor(l_quantity * l_quantity / 2) AS INT) AS textdata,
          CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN part ON l_partkey = p_partkey""",
    ),
    "human": (
        "edits",
        """SELECT *, date_trunc('quarter', "timestamp")::TIMESTAMP AS t FROM edits
        WHERE user_id NOT LIKE 'ip:%' AND lower(username) NOT LIKE '%bot%'""",
    ),
    "registered": (
        "edits",
        "SELECT * REPLACE (TRY_CAST(user_id AS BIGINT) AS user_id) FROM edits WHERE TRY_CAST(user_id AS BIGINT) IS NOT NULL",
    ),
    "bipartite": (
        "registered",
        """SELECT user_id, article_id, CAST("timestamp" AS DATE) AS edit_date,
          sum(ln(nullif(textdata, 0))) AS word_count, count(*) AS num_edits
        FROM registered GROUP BY 1, 2, 3""",
    ),
    "members": ("registered", "SELECT DISTINCT article_id, year, quarter, user_id FROM registered"),
    "sized": (
        "members",
        "SELECT *, count(*) OVER (PARTITION BY article_id, year, quarter) AS k FROM members",
    ),
    "kept_pairs": ("members", coin_pairs("members", "article_id, year, quarter", "user_id")),
    "network": ("kept_pairs", "SELECT e1, e2, count(*) AS weight FROM kept_pairs GROUP BY 1, 2"),
    "ways": ("network", "SELECT e1, e2, weight FROM network UNION ALL SELECT e2, e1, weight FROM network"),
    "firsts": ("human", "SELECT user_id, min(t) AS first_quarter FROM human GROUP BY 1"),
    "contribs": (
        "human firsts",
        """SELECT user_id, sum(ln(textdata + 1)) AS contrib FROM human JOIN firsts USING (user_id)
        WHERE "timestamp" > first_quarter + INTERVAL 93 DAY AND "timestamp" < first_quarter + INTERVAL 186 DAY
        GROUP BY 1""",
    ),
    "monthly": (
        "",
        """SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS article_id, ts AS "timestamp",
          CAST(floor(value) AS INT) AS textdata FROM events""",
    ),
    "admins": ("", "SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE c_custkey % 40 = 1"),
    "roles": (
        "",
        "SELECT c_custkey AS user_id, CAST(c_custkey % 8 AS INT) AS role_id FROM customer WHERE c_custkey % 5 <> 0",
    ),
    "user_comms": ("", "SELECT c_custkey AS user_id, CAST(c_custkey % 37 AS INT) AS community_id FROM customer"),
    "article_comms": ("", "SELECT p_partkey AS article_id, CAST(p_partkey % 37 AS INT) AS community_id FROM part"),
    "vectors": (
        "",
        """SELECT vec_id AS user_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS vec
        FROM embeddings""",
    ),
}


def with_views(uses: str, more: str, sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in VIEWS[name][0].split():
            visit(parent)
        ordered.append(name)

    for name in uses.split():
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in ordered]
    recursive = ""
    if more.startswith("RECURSIVE "):
        recursive, more = "RECURSIVE ", more[len("RECURSIVE "):]
    if more:
        parts.append(more)
    return f"WITH {recursive}{', '.join(parts)} {sql}" if parts else sql


def per_measure(rows: str, keys: str, measures: dict[str, str]) -> str:
    """One grouped subquery for each measure of ``rows``, side by side on ``keys``."""
    parts = [f"(SELECT {keys}, {value} AS {name} FROM {rows} GROUP BY {keys})" for name, value in measures.items()]
    return f"SELECT {keys}, {', '.join(measures)} FROM {f' JOIN '.join(part + (f' USING ({keys})' if k else '') for k, part in enumerate(parts))}"


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({name}, {digits}) AS {name}" for name in names)
