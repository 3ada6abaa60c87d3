"""Extraction, detection and resolution over a small repository that is a literal of the plan; the SQL states what its code says."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve, semantic
from ..sources import detect, extract
from .registry import query

CODE = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@ui/*": ["components/ui/*"], "@config": ["config/index.ts"]}}}',
    "src/components/ui/Button.tsx": """import { useState } from 'react';
import type { Theme } from '@config';

export interface ButtonProps {
  label: string;
}

export function Button(props: ButtonProps) {
  const [on, setOn] = useState(false);
  return <button disabled={on} onClick={() => setOn(true)}>{props.label}</button>;
}
""",
    "src/components/ui/OrderList.tsx": """import { Button } from './Button';
import * as icons from '@ui/icons';
import Select from 'react-select';

export default function OrderList({ orders, open }) {
  return (
    <section>
      {open && <Button label="More" primary />}
      {orders.map((o) => <Row key={o.id} value={o} />)}
      <icons.Cart size={2} />
      <icons.Gone />
      <Select />
      <Missing />
    </section>
  );
}

const Row = ({ value }) => <li>{value.name}</li>;
""",
    "src/components/ui/icons.tsx": "export const Cart = () => <svg />;\nexport { Star } from './star';\n",
    "src/components/ui/index.ts": "export { Button } from './Button';\nexport * from './icons';\n",
    "src/hooks/useOrders.ts": """import { fetchOrders } from '../api/client';
import { useQuery } from '@tanstack/react-query';

export function useOrders() {
  return useQuery(['orders'], fetchOrders);
}
""",
    "src/api/client.ts": """import axios from 'axios';

export async function fetchOrders(id) {
  try {
    return await axios.get(`/api/orders/${id}`);
  } catch (e) {
    return null;
  }
}

export class Client {
  async load(id) {
    return id;
  }
}
""",
    "src/app/api/orders/route.ts": """import { fetchOrders } from 'api/client';
import { log } from 'api/nothing';
import lodash from 'lodash/fp';

export async function GET(request) {
  return Response.json(await fetchOrders(1));
}
""",
    "src/pages/orders.tsx": """import OrderList from '@ui/OrderList';
import { useOrders } from '../hooks/useOrders';

export function OrdersPage() {
  const orders = useOrders();
  fetch('/api/orders/?page=1');
  fetch(`/api/orders/${orders[0]}`);
  return <OrderList orders={orders} />;
}
""",
    "src/utils/format.ts": "export const formatPrice = (n) => n.toFixed(2);\nexport type Price = number;\nconst hidden = 1;\n",
    "src/components/ui/Button.test.tsx": """import { render } from '@testing-library/react';
import { Button } from './Button';

describe('Button', () => {
  it('renders', () => { render(<Button />); });
});
""",
    "src/components/ui/Button.stories.tsx": "import { Button } from '.';\nexport default { title: 'Button', component: Button };\n",
    "src/config/index.ts": "import './env';\nexport type Theme = 'dark';\n",
    "src/config/env.ts": "export const HOST = 'x';\n",
}


def files(spark) -> DataFrame:
    """(file_id, repo, path, text) of the literal repository."""
    rows = json.dumps([{"path": p, "text": t} for p, t in CODE.items()])
    r = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<path:string,text:string>>")).alias("r")).select("r.*")
    return r.select(F.concat(F.lit("shop:"), "path").alias("file_id"), F.lit("shop").alias("repo"), "path", "text")


def _code(spark) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    f = files(spark)
    ts = f.where(~F.col("path").endswith(".json"))
    return f, extract.symbols(ts), extract.imports(ts), extract.exports(ts)


def _name(c: str = "file_id"):
    return F.substring_index(c, "/", -1)


def _values(columns: str, rows: str) -> str:
    """SQL of literal rows: one a line, values separated by ` | `; `-` is null."""
    cell = lambda v: "NULL" if v == "-" else v if v.isdigit() or v in ("true", "false") else "'" + v.replace("'", "''") + "'"
    body = ",\n".join("(" + ", ".join(cell(v.strip()) for v in line.split("|")) + ")" for line in rows.strip().splitlines())
    return f"SELECT * FROM (VALUES\n{body}\n) AS t({columns})"


def _resolved(spark):
    f, _, imports, exports = _code(spark)
    every = imports.select("file_id", "source").unionByName(exports.where("source is not null").select("file_id", "source"))
    return resolve.resolve_imports(every, f.select("file_id", "repo", "path"), resolve.configs(f))


@query(
    _values(
        "file, name, kind, exported, start_line",
        """
        Button.tsx | Button | function | true | 8
        Button.tsx | ButtonProps | interface | true | 4
        OrderList.tsx | OrderList | function | true | 5
        OrderList.tsx | Row | variable | false | 18
        client.ts | Client | class | true | 11
        client.ts | fetchOrders | function | true | 3
        client.ts | load | method | false | 12
        env.ts | HOST | variable | true | 1
        format.ts | Price | type | true | 2
        format.ts | formatPrice | variable | true | 1
        format.ts | hidden | variable | false | 3
        icons.tsx | Cart | variable | true | 1
        index.ts | Theme | type | true | 2
        orders.tsx | OrdersPage | function | true | 4
        route.ts | GET | function | true | 5
        useOrders.ts | useOrders | function | true | 4
        """,
    )
)
def code_symbols(spark, d):
    """Declarations of the repository's files."""
    _, s, _, _ = _code(spark)
    return s.select(_name().alias("file"), "name", "kind", "exported", F.col("start_line").cast("int").alias("start_line"))


@query(
    _values(
        "file, source, imported, local, kind, type_only",
        """
        Button.stories.tsx | . | Button | Button | named | false
        Button.test.tsx | ./Button | Button | Button | named | false
        Button.test.tsx | @testing-library/react | render | render | named | false
        Button.tsx | @config | Theme | Theme | named | true
        Button.tsx | react | useState | useState | named | false
        OrderList.tsx | ./Button | Button | Button | named | false
        OrderList.tsx | @ui/icons | * | icons | namespace | false
        OrderList.tsx | react-select | default | Select | default | false
        client.ts | axios | default | axios | default | false
        index.ts | ./env | - | - | side_effect | false
        orders.tsx | ../hooks/useOrders | useOrders | useOrders | named | false
        orders.tsx | @ui/OrderList | default | OrderList | default | false
        route.ts | api/client | fetchOrders | fetchOrders | named | false
        route.ts | api/nothing | log | log | named | false
        route.ts | lodash/fp | default | lodash | default | false
        useOrders.ts | ../api/client | fetchOrders | fetchOrders | named | false
        useOrders.ts | @tanstack/react-query | useQuery | useQuery | named | false
        """,
    )
)
def code_imports(spark, d):
    """Bindings of imports."""
    _, _, i, _ = _code(spark)
    return i.select(_name().alias("file"), "source", "imported", "local", "kind", "type_only")


@query(
    _values(
        "file, kind, exported, local, source",
        """
        Button.stories.tsx | default | default | - | -
        Button.tsx | declaration | Button | Button | -
        Button.tsx | declaration | ButtonProps | ButtonProps | -
        OrderList.tsx | declaration | default | OrderList | -
        client.ts | declaration | Client | Client | -
        client.ts | declaration | fetchOrders | fetchOrders | -
        env.ts | declaration | HOST | HOST | -
        format.ts | declaration | Price | Price | -
        format.ts | declaration | formatPrice | formatPrice | -
        icons.tsx | declaration | Cart | Cart | -
        icons.tsx | reexport | Star | Star | ./star
        index.ts | declaration | Theme | Theme | -
        index.ts | reexport | Button | Button | ./Button
        index.ts | star | * | - | ./icons
        orders.tsx | declaration | OrdersPage | OrdersPage | -
        route.ts | declaration | GET | GET | -
        useOrders.ts | declaration | useOrders | useOrders | -
        """,
    )
)
def code_exports(spark, d):
    """What files export, and from where."""
    _, _, _, e = _code(spark)
    return e.select(_name().alias("file"), "kind", "exported", "local", "source")


@query(
    _values(
        "file, source, attempted, status, target",
        """
        Button.stories.tsx | . | relative | resolved | src/components/ui/index.ts
        Button.test.tsx | ./Button | relative | resolved | src/components/ui/Button.tsx
        Button.test.tsx | @testing-library/react | non_local | non_local | -
        Button.tsx | @config | alias | resolved | src/config/index.ts
        Button.tsx | react | non_local | non_local | -
        OrderList.tsx | ./Button | relative | resolved | src/components/ui/Button.tsx
        OrderList.tsx | @ui/icons | alias | resolved | src/components/ui/icons.tsx
        OrderList.tsx | react-select | non_local | non_local | -
        client.ts | axios | non_local | non_local | -
        icons.tsx | ./star | relative | unresolved | -
        index.ts | ./Button | relative | resolved | src/components/ui/Button.tsx
        index.ts | ./env | relative | resolved | src/config/env.ts
        index.ts | ./icons | relative | resolved | src/components/ui/icons.tsx
        orders.tsx | ../hooks/useOrders | relative | resolved | src/hooks/useOrders.ts
        orders.tsx | @ui/OrderList | alias | resolved | src/components/ui/OrderList.tsx
        route.ts | api/client | baseUrl | resolved | src/api/client.ts
        route.ts | api/nothing | baseUrl | unresolved | -
        route.ts | lodash/fp | non_local | non_local | -
        useOrders.ts | ../api/client | relative | resolved | src/api/client.ts
        useOrders.ts | @tanstack/react-query | non_local | non_local | -
        """,
    )
)
def code_resolution(spark, d):
    """Imports and re-exports resolved by relative paths, aliases and baseUrl."""
    return _resolved(spark).select(_name().alias("file"), "source", "attempted", "status", F.regexp_replace("target", "^shop:", "").alias("target"))


@query(
    _values(
        "name, kind, structural, imports, export_shape, role, ui, async_, responsibility, confidence",
        """
        Button | component | jsx-return+react-function-component+uses-hooks | @config+react | named | component | jsx-return+uses-hooks |  | ui-control | high
        Button.stories | storybook-story | storybook-meta | . | default | story |  |  |  | high
        Button.test | test-suite | test-describe-block | ./Button+@testing-library/react | none | test |  |  | test-component | high
        Cart | component | jsx-return+react-function-component |  | named | component | jsx-return |  |  | high
        GET | api-handler | api-request+async-function+route-handler | api/client+api/nothing+lodash/fp | named | handler |  | api-request+async-function | fetch-helper | high
        GET | async-data-flow | api-request+async-function | api/client+api/nothing+lodash/fp | named | module |  | api-request+async-function | fetch-helper | medium
        OrderList | component | jsx-return+react-function-component | ./Button+@ui/icons+react-select | default | component | jsx-return |  | ui-select | high
        OrderList | conditional-rendering | conditional-render | ./Button+@ui/icons+react-select | default | module | conditional-render |  |  | high
        OrderList | list-rendering | map-rendering | ./Button+@ui/icons+react-select | default | module | map-rendering |  |  | high
        OrdersPage | component | jsx-return+react-function-component+uses-hooks | ../hooks/useOrders+@ui/OrderList | named | component | jsx-return+uses-hooks |  | layout-component | high
        Row | component | jsx-return+react-function-component | ./Button+@ui/icons+react-select | none | component | jsx-return |  | ui-select | medium
        fetchOrders | async-data-flow | api-request+async-function+error-handling | axios | named | module |  | api-request+async-function+error-handling | fetch-helper | high
        formatPrice | utility-export | named-export |  | named | utility |  |  |  | high
        useOrders | hook | custom-hook+uses-hooks | ../api/client+@tanstack/react-query | named | hook | uses-hooks |  | query-hook | high
        """,
    )
)
def code_patterns(spark, d):
    """Patterns of the repository with their fingerprints."""
    f, s, i, e = _code(spark)
    j = lambda c: F.array_join(c, "+").alias(c)
    p = detect.detect(f.where(~F.col("path").endswith(".json")), s, i, e)
    return p.select("name", "kind", j("structural"), j("imports"), "export_shape", "role", j("ui"), j("async_"), j("responsibility"), "confidence")


@query(
    _values(
        "file, indexed, n_deps, tokens, graph_anchored, strength",
        """
        Button.stories.tsx | true | 1 | components+src+ui | true | medium
        Button.test.tsx | true | 1 | components+src+ui | true | medium
        Button.tsx | true | 1 | config+src | true | medium
        OrderList.tsx | true | 2 | components+src+ui | true | high
        client.ts | true | 0 |  | false | low
        env.ts | true | 0 |  | false | low
        format.ts | true | 0 |  | false | low
        icons.tsx | true | 0 |  | false | low
        index.ts | true | 1 | config+src | true | medium
        index.ts | true | 2 | components+src+ui | true | high
        orders.tsx | true | 2 | components+hooks+src+ui | true | high
        route.ts | true | 1 | api+src | true | medium
        shop:tsconfig.json | false | 0 |  | false | low
        useOrders.ts | true | 1 | api+src | true | medium
        """,
    )
)
def code_anchors(spark, d):
    """Files' structural anchors by their resolved imports."""
    f, _, _, _ = _code(spark)
    dep = _resolved(spark).where("status = 'resolved'").select("file_id", "target")
    a = detect.anchors(f.select("file_id", "path"), dep)
    return a.select(_name().alias("file"), "indexed", F.size("deps").alias("n_deps"), F.array_join("dep_tokens", "+").alias("tokens"), "graph_anchored", "strength")


@query(
    _values(
        "file, line, component, target, symbol, resolution",
        """
        Button.test.tsx | 5 | Button | Button.tsx | function:Button:1 | resolved_local
        OrderList.tsx | 10 | icons.Cart | icons.tsx | variable:Cart:1 | resolved_local
        OrderList.tsx | 11 | icons.Gone | icons.tsx | - | missing_symbol
        OrderList.tsx | 12 | Select | - | - | package
        OrderList.tsx | 13 | Missing | - | - | unresolved
        OrderList.tsx | 8 | Button | Button.tsx | function:Button:1 | resolved_local
        OrderList.tsx | 9 | Row | OrderList.tsx | variable:Row:1 | same_file
        orders.tsx | 8 | OrderList | OrderList.tsx | function:OrderList:1 | resolved_local
        """,
    )
)
def code_components(spark, d):
    """What the components used in JSX resolve to."""
    f, s, i, e = _code(spark)
    uses = extract.components(f.where(~F.col("path").endswith(".json"))).select("file_id", "line_no", "component")
    r = resolve.resolve_components(uses, s, i, _resolved(spark), e)
    return r.select(_name().alias("file"), F.col("line_no").cast("int").alias("line"), "component", _name("target_file").alias("target"), F.regexp_extract("symbol_id", r":(\w+:\w+:\d+)$", 1).alias("symbol"), "resolution")


@query(
    _values(
        "file, line, component, prop, value_kind",
        """
        OrderList.tsx | 10 | icons.Cart | size | expression
        OrderList.tsx | 8 | Button | label | string
        OrderList.tsx | 8 | Button | primary | boolean
        OrderList.tsx | 9 | Row | key | expression
        OrderList.tsx | 9 | Row | value | expression
        orders.tsx | 8 | OrderList | orders | expression
        """,
    )
)
def code_props(spark, d):
    """Properties that components are given."""
    f = files(spark).where(~F.col("path").endswith(".json"))
    p = extract.components(f).where("prop is not null and prop <> ''")
    return p.select(_name().alias("file"), F.col("line_no").cast("int").alias("line"), "component", "prop", "value_kind")


@query(
    _values(
        "file, tokens",
        """
        Button.stories.tsx | .+Button
        Button.test.tsx | ./Button+@testing-library/react+Button+render
        Button.tsx | @config+Theme+react+useState
        OrderList.tsx | ./Button+@ui/icons+Button+Select+icons+react-select
        client.ts | axios
        index.ts | ./env
        orders.tsx | ../hooks/useOrders+@ui/OrderList+OrderList+useOrders
        route.ts | api/client+api/nothing+fetchOrders+lodash+lodash/fp+log
        useOrders.ts | ../api/client+@tanstack/react-query+fetchOrders+useQuery
        """,
    )
)
def code_file_tokens(spark, d):
    """Tokens by which files are found: what they import and bind."""
    _, _, i, _ = _code(spark)
    g = i.groupBy("file_id").agg(F.collect_list("source").alias("s"), F.collect_list("local").alias("n"))
    return g.select(_name().alias("file"), F.array_join(detect.import_tokens(F.col("s"), F.col("n")), "+").alias("tokens"))


def _edges(spark):
    f, s, i, e = _code(spark)
    ts = f.where(~F.col("path").endswith(".json"))
    return ts, s, i, e, semantic.semantic_edges(ts, s, i, e, _resolved(spark))


def _symbol(c: str):
    return F.regexp_extract(c, r":(\w+:\w+):\d+$", 1)


@query(
    _values(
        "kind, from_file, from_symbol, to_file, to_symbol, n, strength",
        """
        api_client_to_route | orders.tsx | function:OrdersPage | route.ts | function:GET | 1 | medium
        call | orders.tsx | function:OrdersPage | useOrders.ts | function:useOrders | 1 | strong
        call | route.ts | function:GET | client.ts | function:fetchOrders | 1 | strong
        jsx | Button.test.tsx | - | Button.tsx | function:Button | 1 | strong
        jsx | OrderList.tsx | function:OrderList | Button.tsx | function:Button | 1 | strong
        jsx | orders.tsx | function:OrdersPage | OrderList.tsx | function:OrderList | 1 | strong
        reference | useOrders.ts | function:useOrders | client.ts | function:fetchOrders | 1 | strong
        """,
    )
)
def code_semantic_edges(spark, d):
    """References, components in JSX and API calls between symbols."""
    x = _edges(spark)[-1]
    return x.select("kind", _name("from_file").alias("from_file"), _symbol("from_symbol").alias("from_symbol"), _name("to_file").alias("to_file"), _symbol("to_symbol").alias("to_symbol"), F.col("n").cast("int").alias("n"), "strength")


@query(
    _values(
        "what, file, line, route, method",
        """
        call | orders.tsx | 6 | /api/orders | GET
        handler | route.ts | - | /api/orders | GET
        """,
    )
)
def code_api_calls(spark, d):
    """Calls of API routes by constant addresses, and the handlers of routes."""
    ts, s, _, _ = _code(spark)
    ts = ts.where(~F.col("path").endswith(".json"))
    calls = semantic.client_calls(ts).select(F.lit("call").alias("what"), _name().alias("file"), F.col("line_no").cast("int").alias("line"), "route", "method")
    return calls.unionByName(semantic.routes(ts, extract.symbols(ts)).select(F.lit("handler").alias("what"), _name().alias("file"), F.lit(None).cast("int").alias("line"), "route", "method"))


@query(
    _values(
        "file, symbol, reason, confidence",
        """
        Button.test.tsx | - | uses-jsx | high
        OrderList.tsx | function:OrderList | uses-jsx | high
        index.ts | - | reexports-target | medium
        """,
    )
)
def code_importer_impacts(spark, d):
    """What a change of Button reaches at once."""
    ts, s, i, e, edges = _edges(spark)
    r = _resolved(spark).where("target = 'shop:src/components/ui/Button.tsx'")
    importers = i.join(r.select("file_id", "source"), ["file_id", "source"]).select("file_id", F.lit("import").alias("kind")).union(e.join(r.select("file_id", "source"), ["file_id", "source"]).select("file_id", F.lit("reexport").alias("kind"))).distinct()
    x = semantic.importer_impacts(edges, importers, "shop:src/components/ui/Button.tsx:function:Button:1", "shop:src/components/ui/Button.tsx")
    return x.select(_name().alias("file"), _symbol("symbol_id").alias("symbol"), "reason", "confidence")


@query(
    _values(
        "symbol, confidence",
        """
        function:OrderList | medium
        """,
    )
)
def code_same_file_impacts(spark, d):
    """What a change of Row reaches in its own file."""
    ts, s, _, _ = _code(spark)
    x = semantic.same_file_impacts(s, "shop:src/components/ui/OrderList.tsx:variable:Row:1", ts)
    return x.select(_symbol("symbol_id").alias("symbol"), "confidence")
