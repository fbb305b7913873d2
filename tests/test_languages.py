"""What each language's reader finds."""

from lodeline.operators import extract as X


def refs(language, text):
    return {(r[2], r[5]): r for r in X.parse(language, text).refs}


def symbols(language, text):
    return {(s[0], s[1], s[4]) for s in X.parse(language, text).symbols}


def test_go():
    text = 'package p\n\nimport (\n\t"fmt"\n\tu "example.com/x/util"\n)\n\nconst Limit = 3\n\ntype Account struct {\n\tOwner *Person\n\tname string\n}\n\nfunc (a *Account) Pay(n int, to *Person) error {\n\ta.check(n)\n\tto.Take(n)\n\tb := NewBank(n)\n\tb.Book()\n\tc := &Card{n}\n\tc.Swipe()\n\tvar d util.Desk\n\td.Sit()\n\treturn fmt.Errorf("x %d", len(a.name))\n}\n\nfunc Caller() {\n\thelper()\n\tutil.Do()\n}\n'
    found = refs("go", text)
    assert {("Account", "struct", None), ("Pay", "method", "Account"), ("Caller", "function", None), ("Limit", "const", None)} <= symbols("go", text)
    assert found["check", "call"][3:5] == ("a", "Account") and found["Take", "call"][4] == "Person"
    assert found["Book", "call"][4] == "Bank" and found["Swipe", "call"][4] == "Card" and found["Sit", "call"][4] == "Desk"
    assert found["helper", "call"][1] == "Caller" and found["helper", "call"][3] is None and found["Do", "call"][3] == "util"
    assert ("example.com/x/util", "import") in found and ("len", "call") not in found and ("Person", "type_ref") in found and ("string", "type_ref") not in found
    pay = next(s for s in X.parse("go", text).symbols if s[0] == "Pay")
    assert pay[2:4] == (14, 24)


def test_rust():
    text = "use crate::storage::{Repository, open as open_db, model::*};\nuse std::io;\n\npub struct Cart<'a> {\n    items: Vec<Item>,\n    name: &'a str,\n}\n\nimpl<'a> Display for Cart<'a> {\n    fn fmt(&self, out: &mut Sink) -> Outcome {\n        self.total(1);\n        out.push('x');\n        Ok(())\n    }\n}\n\nfn run(repo: Repository) -> Option<u32> {\n    repo.commit();\n    let x = crate::storage::open();\n    let c = Cart::new();\n    c.add::<Item>(2);\n    helper(\"fn no() {\");\n    println!(\"{}\", x);\n    Some(1)\n}\n\ntrait Shape { fn area(&self) -> f64; }\n"
    found = refs("rust", text)
    assert {("Cart", "struct", None), ("fmt", "method", "Cart"), ("run", "function", None), ("Shape", "interface", None), ("area", "method", "Shape")} <= symbols("rust", text)
    assert found["open", "call"][3] == "crate::storage" and found["commit", "call"][3:5] == ("repo", "Repository")
    assert found["total", "call"][4] == "Cart" and found["push", "call"][4] == "Sink" and found["add", "call"][4] == "Cart"
    assert found["Repository", "import_binding"][3] == "crate::storage" and ("crate::storage::open", "import") in found and ("open_db", "import_binding") in found and ("crate::storage::model", "import") in found
    assert ("Some", "call") not in found and ("println", "call") not in found and ("no", "call") not in found and ("Item", "type_ref") in found and ("Option", "type_ref") not in found


def test_typescript():
    text = "import React, { useState as useIt, memo } from 'react'\nimport * as api from './api'\nexport { draw } from './draw'\nconst fs = require('fs')\n\nexport class Panel extends Base implements Shown<Item> {\n  private size: Size = 1\n  constructor(private api: Client) { super() }\n  async render(kind?: Kind): Promise<View> {\n    this.layout()\n    kind.apply()\n    const w = new Widget(1)\n    w.open()\n    return parseInt('3')\n  }\n  static make = () => build()\n}\n\nexport const caller = async (x: number) => {\n  api.fetch(x)\n  return `text ${x}`\n}\n\nfunction outer<T>(a: T[]) { return inner(a) }\ntype Alias = Panel | string\ninterface Shape extends Thing { area(): number }\n"
    found = refs("typescript", text)
    assert {("Panel", "class", None), ("render", "method", "Panel"), ("caller", "function", None), ("outer", "function", None), ("Alias", "type", None), ("Shape", "interface", None), ("area", "method", "Shape")} <= symbols("typescript", text)
    assert found["layout", "call"][3:5] == ("this", "Panel") and found["apply", "call"][4] == "Kind" and found["open", "call"][4] == "Widget"
    assert ("Widget", "call") in found and ("parseInt", "call") not in found and found["fetch", "call"][1:4] == ("caller", "fetch", "api") and ("inner", "call") in found
    assert ("Base", "inherit") in found and ("Shown", "inherit") in found and ("Thing", "inherit") in found
    assert found["memo", "import_binding"][3] == "react" and found["draw", "import_binding"][3] == "./draw" and ("./api", "import") in found and ("fs", "import") in found
    assert ("Size", "type_ref") in found and ("View", "type_ref") in found and ("string", "type_ref") not in found


def test_jsx():
    text = "export function App() {\n  return <div class=\"x\"><Foo onClick={handle()} /><Comp.Sub>text</Comp.Sub></div>\n}\n"
    found = refs("tsx", text)
    assert ("Foo", "call") in found and found["Sub", "call"][3] == "Comp" and ("handle", "call") in found and ("div", "call") not in found


def test_java():
    text = "package a.b;\n\nimport com.example.util.Helper;\nimport static java.lang.Math.max;\n\n@Service\npublic class Runner extends Base implements Job<Item> {\n    private final Helper h = new Helper();\n    public <T> int run(List<Order> orders) throws Broken {\n        h.compute(1);\n        Order[] all = local(orders);\n        return max(1, 2);\n    }\n    abstract void stop();\n}\n"
    found = refs("java", text)
    assert {("Runner", "class", None), ("run", "method", "Runner"), ("stop", "method", "Runner")} <= symbols("java", text)
    assert found["compute", "call"][1:4] == ("run", "compute", "h") and found["Helper", "call"][3] is None and ("local", "call") in found
    assert ("com.example.util.Helper", "import") in found and found["Helper", "import_binding"][3] == "com.example.util.Helper"
    assert ("Helper", "type_ref") in found and ("Order", "type_ref") in found and ("List", "type_ref") not in found and ("Base", "inherit") in found and ("Job", "inherit") in found


def test_c_and_cpp():
    text = '#include <stdio.h>\n#include "myutil.h"\n#define MAX(a, b) ((a) > (b) ? (a) : (b))\n\nstruct ctx { int n; };\n\nstatic int caller(ctx_t *c, struct other *o) {\n    helper(1);\n    c->run(2);\n    o->go();\n    printf("call()");\n    return 0;\n}\n'
    found = refs("c", text)
    assert {("ctx", "struct", None), ("caller", "function", None)} <= symbols("c", text)
    assert found["run", "call"][3:5] == ("c", "ctx_t") and found["go", "call"][4] == "other" and found["helper", "call"][1] == "caller"
    assert ("myutil.h", "import") in found and ("stdio.h", "import") not in found and ("printf", "call") not in found and ("MAX", "call") not in found
    cpp = "class Box : public Shape, private ns::Part {\npublic:\n  double area() const override;\n  Box(int n) : n_(n) { init(n); }\n};\n\ndouble Box::area() const {\n  Pen *p = new Pen(1);\n  p->draw();\n  std::sort(a, b);\n  util::scale(n_);\n  this->touch();\n  return 0;\n}\n"
    found = refs("cpp", cpp)
    assert {("Box", "class", None), ("area", "method", "Box")} <= symbols("cpp", cpp)
    assert ("Shape", "inherit") in found and found["Part", "inherit"][3] == "ns" and ("Pen", "call") in found and found["draw", "call"][4] == "Pen"
    assert ("sort", "call") not in found and found["scale", "call"][3] == "util" and found["touch", "call"][4] == "Box"


def test_bash():
    text = "#!/bin/bash\nsource ./lib.sh\nfunction build() {\n  compile_all --fast && echo done\n}\nstop_it () {\n  if check_up; then x=$(find_pid); fi\n}\nbuild\n"
    found = refs("bash", text)
    assert symbols("bash", text) == {("build", "function", None), ("stop_it", "function", None)}
    assert found["compile_all", "call"][1] == "build" and found["check_up", "call"][1] == "stop_it" and ("find_pid", "call") in found and found["build", "call"][1] is None
    assert ("echo", "call") not in found and ("./lib.sh", "import") in found
    ends = {s[0]: s[3] for s in X.parse("bash", text).symbols}
    assert ends == {"build": 4, "stop_it": 7}


def test_broken_sources_end():
    for language in X.PARSERS:
        for text in ("{{{(((", "}}}", "class", "fn f(", "\"unclosed", "/* open", "import {", "type X<", "use a::{b, c"):
            X.parse(language, text)
