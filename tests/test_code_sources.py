"""PHP, TypeScript, YAML and proxy sources, tools and kernels on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import tools
from graphloom.model import DependencyGraph
from graphloom.operators import iterate, maps, render, risk
from graphloom.sources import code, files, infra, php_code, php_routes, php_tokens, revision, text, ts_code, yaml_text
from graphloom.streaming import events as E
from graphloom.streaming import execution

PHP = r"""<?php
namespace App\Http;
use App\Models\{User, Post as P};
use function App\helper;
interface Shape { public function area(): float; }
#[Route('/x')]
final class UserController extends Base implements Shape, \Countable {
    use Logs;
    private ?User $user = null;
    public function __construct(private P $post, protected readonly Mailer $mailer, $raw = []) { parent::__construct(); }
    public function area(): float { return $this->mailer->send($this->user->name) ? 1.0 : 2.0; }
    public function show(User $u, ?int $id = null) {
        $x = new Invoice($u);
        $x->total();
        self::make(); // $x->gone();
        helper(); strlen("new Gone()");
        Http::get('https://api.test/x');
        if ($id && $x || $u) { foreach ($a as $b) {} } elseif ($y) {}
        throw new BadException();
    }
    private static function make() { return static::$cache ?? match(true) { 1 => 2, default => 3 }; }
    public function posts(): HasMany { return $this->hasMany(Comment::class); }
}
function free(array $a): ?string { return null; }
add_action('init', 'free');
require_once __DIR__ . '/../lib/x.php';
"""


def sources(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, content string")


def test_php_source(spark):
    out = php_code.php_files(sources(spark, ("src/a.php", PHP), ("bad.php", "<?php class X { function y( {"), ("none.php", None)))
    nodes = {r["src"]: r for r in out.where("kind = 'node'").collect()}
    c = "App\\Http\\UserController"
    assert set(nodes) == {"App\\Http\\Shape::area", f"{c}::__construct", f"{c}::area", f"{c}::show", f"{c}::make", f"{c}::posts", f"{c}::__model", "func:App\\Http\\free", "file:src/a.php"}
    show = nodes[f"{c}::show"]
    assert (show["line"], show["end_line"], show["cyclomatic"], [tuple(p) for p in show["params"]]) == (12, 20, 6, [("u", "User"), ("id", "int|null")])
    assert nodes[f"{c}::make"]["visibility"] == "private" and nodes[f"{c}::make"]["is_static"] and nodes["App\\Http\\Shape::area"]["is_interface"] and nodes[f"{c}::make"]["cyclomatic"] == 4
    edges = {(r["src"].rpartition("::")[2], r["dst"], r["type"]) for r in out.where("kind = 'edge'").collect()}
    assert {
        ("__construct", "App\\Http\\Base::__parent", "inherits"), ("__construct", "Countable::__interface", "interface_implementation"), ("__construct", "App\\Http\\Logs::__trait", "trait_usage"),
        ("area", "App\\Http\\Mailer::send", "method_call"), ("area", "App\\Models\\User::name", "property_access"), ("show", "App\\Http\\Invoice::__construct", "direct_instantiation"),
        ("show", "App\\Http\\Invoice::total", "method_call"), ("show", f"{c}::make", "static_call"), ("show", "func:App\\helper", "function_call"), ("show", "http:GET:https://api.test/x", "http_call"),
        ("make", f"{c}::cache", "static_property"), ("__model", "App\\Http\\Comment::__model", "model_relationship"), ("file:src/a.php", "func:free", "wp_hook"), ("file:src/a.php", "file:lib/x.php", "include"),
    } <= edges
    assert not any("Gone" in d or "gone" in d or "BadException" in d for _, d, _ in edges)
    scores = {r["node_id"]: r["cyclomatic"] for r in code.complexities(sources(spark, ("a.php", PHP)), php_code.php_complexities).collect()}
    assert scores[f"{c}::show"] == 6


def test_php_tokens_and_routes():
    ts = php_tokens.tokens("<b><?php $a = <<<'E'\nhi;\n  E;\n#[R('/x')]\n$b?->c(\"q\\\"s\"); ?> tail")
    assert [t.text for t in ts if t.kind == "string"] == ["hi;\n", "/x", 'q"s'] and ts[0].kind == ts[-1].kind == "html" and [t.line for t in ts if t.text == "$b"] == [5]
    text = "use A\\{B, C as D};\nRoute::match(['get', 'post'], '/m', [D::class, 'z']);\nRoute::resource('a.bs', B::class)->only(['index', 'show']);\nRoute::get('/f', fn () => 1);"
    assert list(php_routes.structured_routes("r", text)) == [("r", "GET", "/m", "A\\C", "z"), ("r", "POST", "/m", "A\\C", "z"), ("r", "GET", "a/{a}/bs", "A\\B", "index"), ("r", "GET", "a/{a}/bs/{b}", "A\\B", "show")]
    assert [r[1:4] for r in php_routes.plain_routes("r", text)][-1] == ("GET", "/f", "Closure") and len(list(php_routes.plain_routes("r", text))) == 8


def test_ts_source(spark):
    text = r"""
import React, { useState as us } from './lib/api';
import * as util from "../util";
const re = /a['"`]b/g, s = `x ${f(`y`)} z`;
export async function load(id: string): Promise<{a: number}> { const r = await fetch(`/users/${id}`, { method: 'POST' }); us(); util.go(1); return helper(r); }
const helper = async (r: any): Promise<void> => { other(); };
export const other = x => x + 1;
export class Svc extends Base { constructor(private a: A) { super(); } run(): void { this.stop(); new Thing(); axios.get('/x'); } stop = () => { load('1'); } }
app.get('/u/:id', load);
function View() { return <div>don't <b onClick={() => load(2)}>x</b></div>; }
"""
    out = ts_code.ts_files(sources(spark, ("src/web/m.ts", text), ("e.js", "")))
    m = "typescript:src.web.m"
    nodes = {r["src"]: r["http_path"] for r in out.where("kind = 'node'").collect()}
    assert nodes == {f"{m}::load": "/u/{id}", f"{m}::helper": None, f"{m}::other": None, f"{m}.Svc::constructor": None, f"{m}.Svc::run": None, f"{m}.Svc::stop": None, f"{m}::View": None}
    edges = {(r["src"].removeprefix(m), r["dst"].removeprefix(m), r["type"]) for r in out.where("kind = 'edge'").collect()}
    assert edges == {
        ("::load", "http:POST:/users/{*}", "http_call"), ("::load", "ts_import:src.web.lib.api::useState", "import_call"), ("::load", "ts_import:src.util::go", "import_call"), ("::load", "::helper", "method_call"),
        ("::helper", "::other", "method_call"), (".Svc::constructor", ".Base::__parent", "inherits"), (".Svc::run", ".Svc::stop", "method_call"), (".Svc::run", ".Thing::constructor", "instantiation"),
        (".Svc::run", "http:GET:/x", "http_call"), (".Svc::stop", "::load", "method_call"), ("::View", "::load", "method_call"),
    }


def test_yaml_compose_and_proxies(spark):
    text = "# c\nx: &a\n  k: [1, 'two', {a: b}]\nservices:\n  web:\n    image: \"nginx:1\"\n    build: {context: ./web}\n    environment:\n      - SECRET=abc\n      - B\n    depends_on:\n      db:\n        condition: ok\n  db:\n    image: pg  # d\n    environment:\n      PASS: x\n    volumes:\n    - data:/var\n    command: |\n      a: b\n        c\n"
    root = yaml_text.load(text)
    assert root["x"] == {"k": [1, "two", {"a": "b"}]} and root["services"]["db"]["command"] == "a: b\n  c" and yaml_text.load("") is None and yaml_text.load("- a\n- b: 1\n  c: ~\n- - d") == ["a", {"b": 1, "c": None}, ["d"]] or root
    rows = {r["name"]: r for r in infra.compose(sources(spark, ("c.yml", text), ("e.yml", "x"))).collect()}
    assert rows["web"]["env_keys"] == ["SECRET", "B"] and rows["web"]["context"] == "./web" and rows["db"]["volumes"] == ["data"] and rows["web"]["depends_on"] == ["db"] and "abc" not in str(rows)
    caddy = "(snip) {\n reverse_proxy app:80\n}\na.test, b.test {\n import snip\n root * /srv\n handle {\n  reverse_proxy {\n   to z:3\n  }\n }\n}\n"
    nginx = "upstream up { server u1:80; }\nserver { server_name a.test; location / { proxy_pass http://up/x; } root /srv; }"
    apache = '<VirtualHost *:80>\nServerName a.test\nProxyPass / http://x:1/\n</VirtualHost>'
    got = {(r["server"], r["site"], r["kind"], r["target"]) for r in infra.proxies(sources(spark, ("Caddyfile", caddy), ("n.conf", nginx), ("h.conf", apache))).collect()}
    assert {("caddy", "a.test", "proxies_to", "app:80"), ("caddy", "b.test", "proxies_to", "z:3"), ("nginx", "a.test", "proxies_to", "u1:80"), ("nginx", "a.test", "serves", "/srv"), ("apache", "a.test", "proxies_to", "http://x:1/")} <= got
    docker = "FROM --platform=x node:20 AS build\nRUN a \\\n b\nFROM nginx\nEXPOSE 80 443\n"
    assert [(r["image"], r["stage"], r["ports"]) for r in infra.images(sources(spark, ("Dockerfile", docker))).collect()] == [("node:20", "build", []), ("nginx", None, ["80", "443"])]
    assert [tuple(r) for r in infra.contracts(sources(spark, ("o.yaml", "paths:\n  /u/{id}:\n    get:\n      operationId: one\n"), ("b.json", "{"))).collect()] == [("o.yaml", "GET", "/u/{id}", "one")]


def test_scan_skips_environments(spark, tmp_path):
    for name in ("a.py", "env/pyvenv.cfg", "env/lib/b.py", "x/node_modules/c.py", "x/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("é")
    found = files.scan(spark, [str(tmp_path), str(tmp_path / "x")], endings=["py"])
    assert sorted((r["path"].rsplit("/", 1)[1], r["content"], r["size"]) for r in found.collect()) == [("a.py", "é", 2), ("d.py", "é", 2)]


@pytest.mark.parametrize("local", [4_000_000, 0])
def test_kernels_large_and_small(spark, monkeypatch, local):
    """The same components, counts and layers from one task and from rounds of joins."""
    monkeypatch.setattr(iterate, "LOCAL", local)
    ids = "abcdefg"
    g = DependencyGraph.from_rows(spark, [{"class": x, "method": "m"} for x in ids], [(f"{a}::m", f"{b}::m") for a, b in ("ab", "bc", "ca", "cd", "de", "ee", "fe")])
    assert sorted(tuple(r) for r in iterate.strong_components(g.edges).collect()) == [("a::m", f"{x}::m") for x in "abc"]
    assert {r["id"][0]: r["n"] for r in iterate.ancestors(g.edges).collect()} == {"a": 2, "b": 2, "c": 2, "d": 3, "e": 5}
    assert {r["id"][0]: r["layer"] for r in iterate.peel(g.nodes.select("id"), g.edges).collect()} == {"a": None, "b": None, "c": None, "d": 2, "e": 1, "f": 2, "g": 1}


def test_tools_and_renderers(spark):
    g = DependencyGraph.from_rows(spark, [{"class": "App\\Domain\\A", "method": "x"}, {"class": "App\\Infrastructure\\B", "method": "y"}], [("App\\Domain\\A::x", "App\\Infrastructure\\B::y")])
    a = "App\\Domain\\A::x"
    assert tools.impact(g, a)["downstream"] == ["App\\Infrastructure\\B::y"] and tools.lookup(g, "domain")["found"][0]["name"] == "App\\Domain\\A" and not tools.find(g, "b")["truncated"]
    assert tools.architecture(g)["stats"]["critical"] == 1 and tools.walk(g, a)["nodes"][0]["id"] == a and tools.change_risk(g, a)["violation_count"] == 1 and tools.overview(g)["entrypoints"] == 1
    assert set(tools.TOOLS) == {"lookup", "find", "impact", "walk", "change_risk", "architecture", "health", "overview"}
    with pytest.raises(ValueError):
        tools.change_risk(g, "gone::x")
    scored = risk.change_risk(g, complexities=spark.createDataFrame([(a, 40)], "id string, cyclomatic long")).where(F.col("id") == a).first()
    assert scored["cyclomatic"] == 40 and scored["score"] == round((1.5 + 8 + 20) / 2)
    hot = spark.createDataFrame([("a", "HIGH", 30, 1, 2)], "id string, risk string, complexity long, fan_in long, fan_out long")
    assert json.loads(render.hotspots_json(hot))["levels"]["HIGH"][0]["id"] == "a" and "flowchart LR" in render.graph_page(g.edges, "t<") and "t&lt;" in render.graph_page(g.edges, "t<")
    edges = spark.createDataFrame([("s", "t", "http", 2)], "`from` string, `to` string, type string, count long")
    assert "Rel(n0, n1" in render.context_diagram(edges, "x") and maps.lookup_boundary(maps.catalogue_boundaries(edges), "T", "S").first()["calls"] == 2
    assert maps.lookup_path(spark.createDataFrame([("r", 2, "r|a::x"), ("q", 1, "q|b::y")], "root string, depth int, path string"), "A::X").first()["root"] == "r"


def test_revision_sitemap_and_libraries(spark, tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# x\nabc refs/heads/main\n")
    (git / "config").write_text('[remote "origin"]\n\turl = https://me:secret@host.test/a.git\n')
    assert revision.revision(str(tmp_path)) == {"branch": "main", "commit": "abc", "remote": "https://host.test/a.git"} and revision.revision(str(git)) is None
    xml = "<urlset><url><loc> http://a.test/1 </loc></url><url><loc>http://a.test/2</loc></url></urlset>"
    assert [r["loc"] for r in text.sitemap(sources(spark, ("sitemap.xml", xml))).orderBy("seq").collect()] == ["http://a.test/1", "http://a.test/2"]
    links = text.page_links(spark.createDataFrame([(1, "<a href='/x'>a</a><A class=b href=\"/y\">")], "page_id long, html string"))
    assert [r["href"] for r in links.collect()] == ["/x", "/y"]


def test_execution(spark):
    calls = spark.createDataFrame([("add", {"a": "1", "b": "2"}), ("boom", {}), ("gone", {}), ("bad", {})], "nodeId string, inputs map<string,string>").coalesce(1)
    functions = {"add": lambda a, b: int(a) + int(b), "boom": lambda: 1 // 0}
    got = execution.execute(calls, functions, [("list", E.blacklist(["bad"]))]).collect()
    assert [(r["type"], r["nodeId"], r["output"]) for r in got if r["type"] != E.STARTED] == [(E.SUCCEEDED, "add", "3"), (E.FAILED, "boom", None), (E.FAILED, "gone", None), (E.FAILED, "bad", None)]
    assert [r["exception"] for r in got if r["type"] == E.FAILED] == ["ZeroDivisionError: integer division or modulo by zero", "LookupError: node not found: gone", "list: blacklisted bad"]
