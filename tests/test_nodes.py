"""Nodes of scripts and the rules on them."""

from granary.operators import nodes as N

SCRIPT = """import React, { useState } from 'react';
function foo(a) {
  if (a) { useEffect(() => { window.addEventListener("x", a); }, []); }
  const [b, setB] = useState(compute());
  document.getElementById("z").innerHTML = a.b;
  items.map((q) => { useThing(q); });
  db.query("select a from b where c=" + a);
  return <form method="post"><input name="q"/></form>;
}
class K { m() { this.props.x = 1; location.href = a; eval(a); } }
"""


def test_rules(spark):
    rows = [(1, "a.jsx", SCRIPT), (2, "b.js", "const ok = 1;\n"), (3, "c.js", "a b"), (4, "d.js", None), (5, "e.css", "x"), (None, "f.js", "g()"), (6, "g.vue", "<script>\nw.addEventListener('x', y); w.removeEventListener('x', y);\n</script>")]
    df = spark.createDataFrame(rows, "file_id bigint, file_path string, source_code string").selectExpr("*", "1 as no", "2 as kind")
    n = N.nodes(df).persist()
    assert {r.file_id for r in n.filter("kind = 'error'").collect()} == {3}
    assert {r.file_id for r in n.collect()} == {1, 3, 6}
    got = {(r.file_id, r.rule_id, r.line_no) for r in N.match_rules(n).collect()}
    assert got == {
        (1, "critical/xss/unsafe-html", 5), (1, "critical/csrf/missing-token", 8), (1, "critical/sql-injection/joined", 7), (1, "security/script-injection", 10), (1, "security/url/unsafe-redirect", 10),
        (1, "react/hooks/out-of-order", 3), (1, "react/hooks/out-of-order", 6), (1, "react/hooks/expensive-init-state", 4), (1, "react/hooks/invalid-hook-name", 2), (1, "vue/components/memory-leak", 3), (1, "vue/components/prop-mutation", 10),
    }
    assert N.match_rules(N.nodes(df.limit(0))).count() == 0
