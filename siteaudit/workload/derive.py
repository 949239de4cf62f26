"""Inputs the queries derive from the given tables.

Each view is one SELECT that Spark and DuckDB both accept, so a query and its SQL read the
same rows. ``{name}`` stands for a given table. Views grow with the table they read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from siteaudit.plans.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables that may arrive as one file and are worth spreading over the cores.
LARGE = ("lineitem", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str, large: tuple[str, ...] = LARGE) -> DataFrame:
    """``large`` names the tables to spread: none where the rows are dealt by key at once."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    used = {t: spread(df) if t in large else df for t, df in used.items()}
    text = text.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same SELECT for DuckDB, as a parenthesised subquery."""
    return "(" + re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", text) + ")"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---- findings, from order lines --------------------------------------------------------

RID = (
    "CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || "
    "CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) || '-' || "
    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20))"
)

FINDINGS = f"""
SELECT {RID} AS rid,
  'src/' || CASE l_partkey % 5 WHEN 0 THEN 'components' WHEN 1 THEN 'pages' WHEN 2 THEN 'lib'
    WHEN 3 THEN 'vendor' ELSE 'tests' END || '/s' || CAST(l_suppkey AS VARCHAR(20)) || '/f'
    || CAST(l_partkey AS VARCHAR(20)) || '.tsx' AS path,
  'RULE_' || CAST((l_partkey * 7 + l_linenumber) % 40 AS VARCHAR(20)) AS detector_id,
  CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'layout'
    WHEN 2 THEN 'forms' ELSE 'motion' END AS category,
  'T' || CAST(1 + (l_linenumber + l_suppkey) % 4 AS VARCHAR(20)) AS tier,
  CASE (l_linenumber + l_suppkey) % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning'
    WHEN 2 THEN 'error' ELSE 'critical' END AS severity,
  0.5E0 + 0.125E0 * (l_orderkey % 5) AS confidence,
  CASE l_orderkey % 10 WHEN 0 THEN 'informational' WHEN 1 THEN 'investigate'
    WHEN 2 THEN 'suppressed' WHEN 3 THEN 'verified_resolved' ELSE 'pending' END AS status,
  CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'runtime' ELSE 'manual' END
    AS provenance,
  CAST(l_orderkey % 400 + 1 AS INT) AS line,
  CAST(l_suppkey % 80 + 1 AS INT) AS col,
  'Rule ' || CAST((l_partkey * 7 + l_linenumber) % 40 AS VARCHAR(20)) || ' in '
    || l_linestatus AS message,
  CAST(l_quantity AS INT) AS qty, l_suppkey AS site, l_partkey AS partkey, l_orderkey AS okey,
  l_linenumber AS lno
FROM {{lineitem}}
"""

# ---- measured elements, from order lines -----------------------------------------------

ELEMENTS = f"""
SELECT {RID} AS rid, 'cap' || CAST(l_suppkey AS VARCHAR(20)) AS capture_id,
  'p' || CAST(l_partkey % 5 AS VARCHAR(20)) AS parent,
  'g' || l_returnflag AS grp,
  l_orderkey * 10 + l_linenumber AS ord,
  CASE l_linenumber WHEN 1 THEN 'button' WHEN 2 THEN 'a' WHEN 3 THEN 'div' WHEN 4 THEN 'h1'
    WHEN 5 THEN 'h2' WHEN 6 THEN 'h3' ELSE 'p' END AS tag,
  CASE l_linenumber WHEN 1 THEN 'button' WHEN 2 THEN 'link' ELSE '' END AS role,
  'owner' || CAST(l_suppkey % 25 AS VARCHAR(20)) AS owner,
  '#e' || {RID} AS selector,
  CAST((l_orderkey * 37 + l_partkey * 11) % 1200 AS DOUBLE) AS x,
  CAST((l_orderkey * 13 + l_linenumber * 40) % 40000 AS DOUBLE) AS y,
  l_quantity * 2E0 AS width, l_quantity AS height,
  CAST(12 + (l_partkey * 3 + l_linenumber) % 4 * 8 AS DOUBLE) AS font_size,
  CAST(400 + (l_orderkey % 3) * 150 AS DOUBLE) AS font_weight,
  CASE WHEN l_orderkey % 7 = 0 THEN 'red' ELSE 'black' END AS color,
  CASE WHEN l_orderkey % 11 = 0 THEN 'grey' ELSE 'white' END AS background,
  l_orderkey AS okey, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS lno,
  l_quantity AS qty, l_linestatus AS ls, CAST(round(l_tax * 100) AS BIGINT) AS tax,
  CAST(round(l_discount * 100) AS BIGINT) AS disc
FROM {{lineitem}}
"""

# ---- source files, from customers ------------------------------------------------------

# Snippets a file contains when (key * 7 + position * 3) % 5 = 0.
TSX = [
    "import React from 'react';\n",
    "import { useState } from 'react';\n",
    "import { motion } from 'framer-motion';\n",
    "import { Check, X as Cross } from 'lucide-react';\n",
    "const [open, setOpen] = useState(null);\n",
    '<div className="p-4 font-inter rounded-2xl shadow-2xl animate-bounce">\n',
    '<button className="bg-black text-white outline-none">Go</button>\n',
    '<button className="flex hidden text-sm text-lg"><svg viewBox="0 0 1 1"></svg></button>\n',
    '<a href="https://x.example" target="_blank">x</a>\n',
    '<img src="/a.png">\n<video src="m.mp4"></video>\n',
    '<input type="text" placeholder="Name">\n',
    "<label>Lonely</label>\n",
    '<label for="ok">Paired</label>\n',
    'console.log("debug"); // TODO tidy\n',
    'const u = "http://localhost:3000/api";\n',
    "document.cookie = 'a=1';\n",
    "el.innerHTML = html;\n",
    "useEffect(() => { localStorage.getItem('k'); }, []);\n",
    "const v: any = x!.y;\n",
    "const q = useQuery(key);\n",
    "{items.map((i) => (<Row name={i} />))}\n",
    "{items.map((i) => (<Row key={i} />))}\n",
    '<span className="opacity-0 group-hover:opacity-100">?</span>\n',
    '<p className="font-bold">Free Pro Enterprise</p><p className="font-normal">Lorem ipsum</p>\n',
    "<p>© 2024 Acme</p>\n",
    "const a = b ? c ? 1 : 2 : d ? e ? 3 : 4 : 5;\n",
    'window.addEventListener("scroll", onScroll);\n',
    '<select id="s"><option>1</option></select>\n',
    "<Table><tr><th onClick={sort}>Name</th></tr></Table>\n",
]
CSS = [
    "@font-face { font-family: X; src: url(x.woff); }\n",
    "body { font-family: Inter, sans-serif; color: #000000; }\n",
    ".card { color: red !important; }\n",
    "@media (prefers-reduced-motion: reduce) { * { animation: none !important; } }\n",
    ".nav { position: sticky; z-index: 9999; }\n",
    ".nav2 { position: sticky; top: 0; }\n",
    "html { scroll-behavior: smooth; }\n",
    ".g { display: grid; grid-template-columns: repeat(3, 1fr); }\n",
    ".h { transition: all 0.3s ease; width: 300px; }\n",
    ":focus { outline: none; }\n",
    ".btn:hover { color: blue; } .btn:focus-visible { outline: 2px solid; }\n",
    ".f { float: left; margin: 13px; box-shadow: 0 0 20px #3b82f6; }\n",
    ":root { --brand: #3366ff; --gap: 8px; }\n",
    "@media (max-width: 768px) { .a { display: none; } }\n",
    "@media (min-width: 1024px) { .a { display: block; } }\n",
    ".r { background: rgba(0,0,0,.1); color: rgba(1,1,1,.2); border: rgba(2,2,2,.3); }\n",
    ".s { background: hsla(1,1%,1%,.1); fill: hsla(2,2%,2%,.2); }\n",
]
HTML = [
    '<html lang="en"><head><title>T</title>\n',
    '<meta name="description" content="d">\n',
    '<link rel="icon" href="/f.ico">\n',
    "</head><body><nav><a href=\"/x\">x</a></nav>\n",
    "<main><h1>Our Big Plain Title</h1></main>\n",
    '<img src="a.png" width="1" height="1">\n',
    '<img src="data:x">\n',
    '<div onClick="go()">go</div>\n',
    "<div><div><div></div></div></div>\n" * 8,
    '<form><input type="email" name="e"><button>Send</button></form>\n',
    '<form action="/s"><button type="submit">Send</button></form>\n',
    '<video src="m.mp4" autoplay></video>\n',
    '<a href="#">top</a>\n',
    "<label>Name <input type=\"text\"></label>\n",
    "<p>Oops! Something went wrong</p>\n",
    '<div class="card"><div class="card">in</div></div>\n',
    "<p>Rated 99% by 100% of users</p>\n",
]


def _text(snips: list[str]) -> str:
    parts = [
        f"CASE WHEN (c_custkey * 7 + {i} * 3) % 5 = 0 THEN {_sql(s)} ELSE '' END"
        for i, s in enumerate(snips)
    ]
    return " || ".join(parts)


def _sql(s: str) -> str:
    # Newlines and quotes are spelled out so both dialects read the same literal.
    return "'" + s.replace("'", "~Q~").replace("\n", "~N~") + "'"


def _clean(expr: str) -> str:
    return f"replace(replace({expr}, '~N~', chr(10)), '~Q~', chr(39))"


FILES = f"""
SELECT 'pkg' || CAST(c_nationkey AS VARCHAR(20)) AS root,
  'pkg' || CAST(c_nationkey AS VARCHAR(20)) || '/' || CASE c_custkey % 4 WHEN 0 THEN 'src'
   WHEN 1 THEN 'app' WHEN 2 THEN 'components' ELSE 'lib' END || '/C'
   || CAST(c_custkey AS VARCHAR(20)) || '.' || ext AS path, ext, content, key
FROM (
  SELECT c_custkey, c_nationkey, c_custkey AS key,
    CASE c_custkey % 3 WHEN 0 THEN 'tsx' WHEN 1 THEN 'css' ELSE 'html' END AS ext,
    {_clean('CASE c_custkey % 3 WHEN 0 THEN ' + _text(TSX) + ' WHEN 1 THEN ' + _text(CSS)
            + ' ELSE ' + _text(HTML) + ' END')} AS content
  FROM {{customer}}) c
"""

PAGES = """
SELECT page_id, 'p' || CAST(page_id AS VARCHAR(20)) || '.html' AS path, 'html' AS ext,
  html AS content, url,
  regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS host
FROM {pages}
"""
