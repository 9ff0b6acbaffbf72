"""Plans that read source text. Files of several statements are made of the suppliers, one or more each: {k} is the supplier's number, {m} that modulo 9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import sqltext
from graphloom.operators import lineage
from graphloom.operators.links import link_calls
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables

_K, _M = "CAST(s_suppkey AS STRING)", "CAST(s_suppkey % 9 AS STRING)"


def text_sql(template: str | None) -> str:
    """SQL for a template's text."""
    if template is None:
        return "NULL"
    quoted = template.replace("'", "''")
    return "'" + quoted.replace("{k}", f"' || {_K} || '").replace("{m}", f"' || {_M} || '") + "'"


def told(names: str, *rows: tuple, where: str = "") -> str:
    """SQL for rows of templates, for each supplier."""
    columns = names.split(", ")
    return " UNION ".join("SELECT " + ", ".join(f'{text_sql(v) if v is None or isinstance(v, str) else f'CAST({v} AS DOUBLE)' if isinstance(v, float) else v} AS "{n}"' for v, n in zip(row, columns, strict=True)) + f" FROM supplier {where}" for row in rows)


def _filled(template: str) -> Column:
    k = F.col("s_suppkey")
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), k.cast("string")), F.lit("{m}"), (k % 9).cast("string"))


def files(t: Tables, *made: tuple[str, str]) -> DataFrame:
    """path, text of (path, text) templates."""
    out = None
    for path, text in made:
        one = t.supplier.select(_filled(path).alias("path"), _filled(text).alias("text"))
        out = one if out is None else out.union(one)
    return out


_SQL = "CASE l_linenumber % 4 WHEN 0 THEN 'insert into db.t' || CAST(l_partkey % 50 AS STRING) || ' select * from s' || CAST(l_suppkey % 20 AS STRING) || ', lateral (select 1 from dual) x' WHEN 1 THEN 'update only \"t' || CAST(l_partkey % 50 AS STRING) || '\" set a = 1 from t' || CAST(l_partkey % 50 AS STRING) WHEN 2 THEN 'delete from t' || CAST(l_partkey % 50 AS STRING) || ' where a in (select a from only)' ELSE 'select 1 from t' || CAST(l_partkey % 50 AS STRING) || ' join s' || CAST(l_suppkey % 20 AS STRING) || ' on 1 = 1' END"


@query("lin-06", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 < 3 THEN 't' || CAST(l_partkey % 50 AS STRING) ELSE '' END AS writes, CASE l_linenumber % 4 WHEN 0 THEN 's' || CAST(l_suppkey % 20 AS STRING) WHEN 3 THEN 't' || CAST(l_partkey % 50 AS STRING) || ',s' || CAST(l_suppkey % 20 AS STRING) ELSE '' END AS reads FROM lineitem""")
def table_access(t: Tables) -> DataFrame:
    w, r = sqltext.table_access(F.col("sql"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_SQL).alias("sql")).select("l_orderkey", "l_linenumber", F.concat_ws(",", w).alias("writes"), F.concat_ws(",", r).alias("reads"))


@query("set-04", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS reads FROM lineitem""")
def write_wins(t: Tables) -> DataFrame:
    """Reads of a statement without what it writes."""
    _, r = sqltext.table_access(F.col("sql"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_SQL).alias("sql")).select("l_orderkey", "l_linenumber", F.size(r).alias("reads"))


@query("flt-17", "SELECT p_partkey, p_partkey % 6 IN (0, 4) AS ok FROM part")
def plausible(t: Tables) -> DataFrame:
    names = ("orders", "SELECT", "12", "a", "t1", "lateral")
    return t.part.select("p_partkey", sqltext.plausible_table(F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("ok"))


_DDL = """-- tables
CREATE TABLE IF NOT EXISTS "db"."T{k}" (id BIGINT NOT NULL, key varchar(32), index int, amount DECIMAL(10, 2) DEFAULT 0,
  note text default 'a, (b', `unique` int, ID int, PRIMARY KEY (id, amount), KEY idx_a (key, index), CONSTRAINT c CHECK (amount > 0));
create table u{m}(a int);
create table broken (a int"""
_DDL_ROWS = (("T{k}", "id", "bigint"), ("T{k}", "key", "varchar(32)"), ("T{k}", "index", "int"), ("T{k}", "amount", "decimal(10,2)"), ("T{k}", "note", "text"), ("T{k}", "unique", "int"), ("u{m}", "a", "int"))


@query("lin-01", told("path, table, column, type", *(("{k}.sql", a.lower(), b, c) for a, b, c in _DDL_ROWS)))
def ddl(t: Tables) -> DataFrame:
    return lineage.ddl(files(t, ("{k}.sql", _DDL)))


@query("lin-02", told("path, at, part", ("{k}", 0, "id int"), ("{k}", 1, "amount decimal(10,2)"), ("{k}", 2, "note text default 'a, (b{k}'"), ("{k}", 3, "check (a in (1, 2))")))
def column_split(t: Tables) -> DataFrame:
    return lineage.scan(files(t, ("{k}", "id int, amount decimal(10,2),, note text default 'a, (b{k}', check (a in (1, 2)) ")), lambda x: enumerate(sqltext.split_columns(x)), "at int, part string")


@query("lin-03", told("path, column, type", ("{k}", "id", "bigint"), ("{k}", "key", "varchar(32)"), ("{k}", "order{m}", "int")))
def column_parse(t: Tables) -> DataFrame:
    return lineage.scan(files(t, ("{k}", 'id bigint, key varchar(32), "order{m}" int, KEY (id), UNIQUE (id), fulltext (id), id text')), sqltext.table_columns, "column string, type string")


@query("lin-04", told("path, body", ("{k}", "a int, b decimal(1,{m}), c text default ')'")))
def table_body(t: Tables) -> DataFrame:
    """What the bracket closes that does so, whatever strings hold; of an open one nothing."""
    made = files(t, ("{k}", "create table t (a int, b decimal(1,{m}), c text default ')') engine = x"), ("open{k}", "create table t (a int"))
    return lineage.scan(made, lambda x: [(b,) for b in [sqltext.table_body(x, x.index("("))] if b is not None], "body string")


@query("lin-05", told("source, target, kind", *((f"p:db_table:{a.lower()}", f"p:db_column:{a.lower()}.{b}", "defines_column") for a, b, _ in _DDL_ROWS)) + " UNION " + told("source, target, kind", *(("p:db_table:" + a.lower(), None, "node") for a in ("T{k}", "u{m}"))) + " UNION " + told("source, target, kind", *((f"p:db_column:{a.lower()}.{b}", None, "node") for a, b, _ in _DDL_ROWS)))
def table_emission(t: Tables) -> DataFrame:
    nodes, edges = lineage.table_nodes(lineage.ddl(files(t, ("{k}.sql", _DDL))), "p")
    return edges.select("source", "target", "kind").union(nodes.select("id", F.lit(None).cast("string"), F.lit("node")))


_PY = '''STATEMENT = "select a from config"
def save(x):
    """select is no statement here"""
    def inner():
        db.execute("insert or replace into T{m} select * from src")
    db.execute("update orders set a = 1 where b in (select b from parts)")
async def load():
    return q("with x as (select 1) select * from x join log on 1 = 1")
text = "please update your data"
'''
_PY_ROWS = (("<{k}.py>", "config", "reads_table"), ("inner", "t{m}", "writes_table"), ("inner", "src", "reads_table"), ("save", "orders", "writes_table"), ("save", "parts", "reads_table"), ("load", "log", "reads_table"))


@query("lin-07", "SELECT * FROM (" + told("path, function, table, access", *(("a/{k}.py", *r) for r in _PY_ROWS)) + ")")
def python_dml(t: Tables) -> DataFrame:
    found = lineage.python_sql(files(t, ("a/{k}.py", _PY), ("bad{k}.py", "def (")))
    return found.where("length(table) > 1")


_CORE = """orders{k} = Table("Orders{k}", meta, Column("ID", Integer, primary_key=True), Column("note", Text()), schema="x")
parts = Table("parts", meta, Column("id", Integer))
def save(conn):
    t = orders{k}
    conn.execute(insert(t).values(a=1))
    conn.execute(select(t.c.id).select_from(parts))
def load(conn):
    return conn.execute(select(orders{k}).join(parts, x)), select(unknown)
"""


@query("lin-18", told("path, table, column, type", ("{k}.py", "orders{k}", "id", "Integer"), ("{k}.py", "orders{k}", "note", "Text"), ("{k}.py", "parts", "id", "Integer")))
def core_tables(t: Tables) -> DataFrame:
    return lineage.core_tables(files(t, ("{k}.py", _CORE))).drop("variable")


@query("lin-08", told("path, function, table, access", ("{k}.py", "save", "orders{k}", "writes_table"), ("{k}.py", "save", "parts", "reads_table"), ("{k}.py", "load", "orders{k}", "reads_table"), ("{k}.py", "load", "parts", "reads_table")))
def core_dml(t: Tables) -> DataFrame:
    made = files(t, ("{k}.py", _CORE))
    return lineage.core_accesses(made, lineage.core_tables(made))


@query("lin-09", told("source, target, kind", ("p:backend_function:a/{k}.py:save", "p:db_table:orders", "writes_table"), ("p:backend_function:a/{k}.py:save", "p:db_table:parts", "reads_table"), ("p:backend_function:a/{k}.py:inner", "p:db_table:t{m}", "writes_table"), ("p:backend_function:a/{k}.py:inner", "p:db_table:src", "reads_table")) + " UNION " + told("source, target, kind", ("p:db_table:parts", None, "stub"), ("p:db_table:src", None, "stub"), ("p:db_table:t{m}", None, "stub")))
def access_emission(t: Tables) -> DataFrame:
    """Edges of accesses, and a node for each table that is not known."""
    found = lineage.python_sql(files(t, ("a/{k}.py", _PY))).where("function IN ('save', 'inner')")
    edges, stubs = lineage.access_edges(found, t.spark.createDataFrame([("orders",)], "table string"), "p")
    return edges.select("source", "target", "kind").union(stubs.select("id", F.lit(None).cast("string"), F.lit("stub")))


_JAVA = """package x;
@Mapper
public interface OrderMapper extends BaseMapper<Order{k}> {
  @Select({"select * from orders{k} o", " join parts on f(o.id) = 1"})
  @Options(useCache = true)
  List<Order> find(int a);
  @Insert("insert into log (a) values (#{a})") int add(Order o);
  @Select("no table here") int none();
}
"""


@query("lin-10", told("path, function, table, access", ("{k}.java", "find", "orders{k}", "reads_table"), ("{k}.java", "find", "parts", "reads_table"), ("{k}.java", "add", "log", "writes_table")))
def java_annotations(t: Tables) -> DataFrame:
    return lineage.java_sql(files(t, ("{k}.java", _JAVA)))


_HBM = """<?xml version="1.0"?>
<!DOCTYPE hibernate-mapping PUBLIC "x" "y">
<hibernate-mapping>
  <class name="com.x.Order{k}" table="`OMS_ORDER{k}`">
    <id name="id" column="ID"/>
    <property name="note"><column name="NOTE"/><column name="NOTE2"/></property>
    <property name="calc" formula="1"/>
    <joined-subclass name="com.x.Big" table="big{m}"><key column="ORDER_ID"/></joined-subclass>
    <subclass name="com.x.Small"><property name="z" column="Z"/></subclass>
  </class>
</hibernate-mapping>"""
_HBM_ROWS = (("Order{k}", "oms_order{k}", "id"), ("Order{k}", "oms_order{k}", "note"), ("Order{k}", "oms_order{k}", "note2"), ("Big", "big{m}", "order_id"))


@query("lin-13", told("path, entity, table, column", *(("{k}.hbm.xml", *r) for r in _HBM_ROWS)))
def hibernate_mapping(t: Tables) -> DataFrame:
    return lineage.mapping_files(files(t, ("{k}.hbm.xml", _HBM), ("bad{k}.hbm.xml", "<hibernate-mapping>"), ("pom{k}.xml", "<project/>")))


_HQL = """class OrderDao {
  List a() { return q("from Order{k} o join Big b where o.id = 1"); }
  int b() { return q("update Order{k} set a = 1"); }
  String c = "from Menu m";
}
class OtherDao { int d() { return q("delete from Big where 1 = 1") + q("say from Order{k}"); } }
"""


@query("lin-11", told("path, function, table, access", ("{k}.java", "OrderDao", "oms_order{k}", "reads_table"), ("{k}.java", "OrderDao", "big{m}", "reads_table"), ("{k}.java", "OrderDao", "oms_order{k}", "writes_table"), ("{k}.java", "OtherDao", "big{m}", "writes_table"), where="WHERE s_suppkey < 9"))
def hibernate_queries(t: Tables) -> DataFrame:
    few = files(t, ("{k}.hbm.xml", _HBM), ("{k}.java", _HQL)).where(F.regexp_extract("path", "^([0-9]+)", 1).cast("int") < 9)
    # In a project an entity has one table.
    entities = lineage.mapping_files(few).select("path", "entity", "table").distinct()
    own = lineage.hql(few, entities)
    return own.where((F.regexp_extract("path", "^([0-9]+)", 1) == F.regexp_extract("table", "([0-9]+)$", 1)))


_MAPPER = """<?xml version="1.0"?><mapper namespace="com.x.User{k}Mapper">
  <!-- update none -->
  <select id="find" resultType="x"><![CDATA[ select * from users{k} where a < #{a} ]]> <if test="b != null"> and exists (select 1 from roles) </if></select>
  <update id="put" > update <include refid="x"/> users{k} <set><if test="a">a = ${a}</if></set></update>
  <delete id="drop">delete from log <where>a = 1</where></delete>
  <sql id="x">only</sql>
</mapper>"""


@query("lin-12", told("path, function, table, access", ("{k}.xml", "User{k}Mapper.find", "users{k}", "reads_table"), ("{k}.xml", "User{k}Mapper.find", "roles", "reads_table"), ("{k}.xml", "User{k}Mapper.put", "users{k}", "writes_table"), ("{k}.xml", "User{k}Mapper.drop", "log", "writes_table")))
def xml_mapper(t: Tables) -> DataFrame:
    return lineage.mappers(files(t, ("{k}.xml", _MAPPER), ("beans{k}.xml", '<beans><select id="a">select * from users</select></beans>')))


_PLUS = """@TableName(value = "db.T_Order{k}", autoResultMap = true)
@Data
public class Order{k} { }
"""


@query("lin-14", told("path, function, table, access", ("{k}.java", "OrderMapper", "t_order{k}", "reads_table"), ("{k}.java", "OrderMapper", "t_order{k}", "writes_table")))
def mybatis_plus(t: Tables) -> DataFrame:
    return lineage.plus_mappers(files(t, ("{k}.java", _JAVA), ("e/{k}.java", _PLUS)))


_JPA = """@Entity
@Table(schema = "x", name = "T_User{k}")
public class User{k} extends Base {
  @Id
  @Column(name = "USER_ID", nullable = false)
  private Long id;
  @Column
  @NotNull
  protected String note = "a";
  private int other;
}

@Entity
class NoTable { @Column(name = "x") private int x; }
"""


@query("lin-15", told("path, entity, table, column", ("{k}.java", "User{k}", "t_user{k}", "user_id"), ("{k}.java", "User{k}", "t_user{k}", "note")))
def jpa_entities(t: Tables) -> DataFrame:
    return lineage.entities(files(t, ("{k}.java", _JPA)))


_QMODEL = """public class QUser{k} extends BaseModelExpression<User{k}, Long> {
  public static final BaseModelExpression<User{k}, Long> user{k} = new QUser{k}();
}
"""
_SERVICE = """class Service {
  public List<User> find(int a) throws X {
    return dao.list(QUser{k}.user{k}.select(1));
  }
  private static int none() { return QUser{k}.other.select(1); }
  protected long total() { return QUser{k} . user{k} . selectCount(2) + QOther.x.select(1); }
}
"""


@query("lin-16", told("path, function, table", ("s/{k}.java", "find", "t_user{k}"), ("s/{k}.java", "total", "t_user{k}")))
def dao_queries(t: Tables) -> DataFrame:
    made = files(t, ("{k}.java", _JPA), ("q/{k}.java", _QMODEL), ("s/{k}.java", _SERVICE))
    return lineage.model_queries(made, lineage.entities(made).select("entity", "table"))


_ORM = """class OrderLine(models.Model):
    amount = models.DecimalField(max_digits=3)
    note = CharField()
    class Meta:
        ordering = ["a"]
class Named(models.Model):
    a = models.TextField()
    class Meta:
        db_table = "Named_{k}"
class M(Base):
    __tablename__ = 'T{k}'
    id = Column(Integer)
    other = 3
class NoTable(Base):
    id = Column(Integer)
class Plain:
    a = models.TextField()
"""


@query("lin-17", told("path, class, table, column", ("{k}.py", "OrderLine", "order_line", "amount"), ("{k}.py", "OrderLine", "order_line", "note"), ("{k}.py", "Named", "named_{k}", "a"), ("{k}.py", "M", "t{k}", "id")))
def orm(t: Tables) -> DataFrame:
    return lineage.models(files(t, ("{k}.py", _ORM)))


def _plugin(t: Tables) -> tuple[DataFrame, DataFrame]:
    made = files(t, ("{k}.sql", _DDL), ("a/{k}.py", _PY), ("core{k}.py", _CORE), ("tests/{k}.sql", "create table ghost (a int);"), ("m/{k}.xml", _MAPPER), ("q/{k}.java", _JPA))
    return lineage.sql_plugin(made, "p")


_ACCESS = (
    *(("p:backend_function:a/{k}.py:" + f, "p:db_table:" + x, a, 1.0) for f, x, a in _PY_ROWS),
    ("p:backend_function:core{k}.py:save", "p:db_table:orders{k}", "writes_table", 0.9), ("p:backend_function:core{k}.py:save", "p:db_table:parts", "reads_table", 0.9), ("p:backend_function:core{k}.py:load", "p:db_table:orders{k}", "reads_table", 0.9), ("p:backend_function:core{k}.py:load", "p:db_table:parts", "reads_table", 0.9),
    ("p:backend_function:m/{k}.xml:User{k}Mapper.find", "p:db_table:users{k}", "reads_table", 1.0), ("p:backend_function:m/{k}.xml:User{k}Mapper.find", "p:db_table:roles", "reads_table", 1.0), ("p:backend_function:m/{k}.xml:User{k}Mapper.put", "p:db_table:users{k}", "writes_table", 1.0), ("p:backend_function:m/{k}.xml:User{k}Mapper.drop", "p:db_table:log", "writes_table", 1.0),
)


@query("lin-19", told("source, target, kind, confidence", *_ACCESS))
def sql_plugin(t: Tables) -> DataFrame:
    """The accesses that all SQL sources of a project give."""
    return _plugin(t)[1].where("kind <> 'defines_column' AND length(target) > 12")


_API = '''router = APIRouter(prefix="/v{m}")
@router.get("/s/{k}", tags=["a"])
@cached
async def read(x):
    return 1
@app.post("/s")
def write(x: int):
    return 2
@helper.thing("/no")
def other(): pass
'''


@query("lin-20", told("path, method, url, handler, line", ("{k}.py", "GET", "/v{m}/s/{k}", "read", 4), ("{k}.py", "POST", "/s", "write", 7)))
def fastapi(t: Tables) -> DataFrame:
    return lineage.fastapi(files(t, ("{k}.py", _API), ("bad{k}.py", "@app.get('/x')\ndef (")))


_SPRING = """@RestController
@RequestMapping("/api/{m}/")
public class OrderController implements Base, OrderApi{k} {
  @GetMapping("/a/{k}")
  @Auth(x = "y")
  public Result<List<Order>> find(int a) { return null; }
  @RequestMapping(value = "b", method = RequestMethod.DELETE) void drop() {}
}
"""
_SPRING_API = """@RequestMapping("/base")
public interface OrderApi{k} { @PostMapping(value = "/c") Result put(Order o); }
"""


@query("lin-21", told("path, method, url, handler, controller_file", ("{k}.java", "GET", "/api/{m}/a/{k}", "find", "{k}.java"), ("{k}.java", "DELETE", "/api/{m}/b", "drop", "{k}.java"), ("i/{k}.java", "POST", "/api/{m}/c", "put", "{k}.java")))
def spring(t: Tables) -> DataFrame:
    return lineage.spring(files(t, ("{k}.java", _SPRING), ("i/{k}.java", _SPRING_API)))


_NODE = """const app = express();
app.use('/mount{m}', auth);
app.get('/a/{k}/', (req, res) => { cache.get('/no/route'); });
orderRouter.post("/b", f); other.delete('/c', g);
"""


@query("lin-22", "SELECT min(path) AS path, method, url FROM (" + told("path, method, url", ("{k}.js", "USE", "/mount{m}"), ("{k}.js", "GET", "/a/{k}"), ("{k}.js", "POST", "/b")) + ") GROUP BY method, url")
def express(t: Tables) -> DataFrame:
    return lineage.express(files(t, ("{k}.js", _NODE)))


_CS = """[ApiController]
[Route("api/[controller]")]
public class OrderController : ControllerBase {
  [HttpGet("{m}")]
  [Authorize]
  public async Task<ActionResult<Order>> Find(int a) { return null; }
  [Produces("x"), HttpPost]
  public void Add(Order o) { }
}
public class OtherController : ControllerBase {
  [HttpPut("x/{k}")] public void Put() { }
}
"""
_CS_ROWS = told("path, method, url, handler", ("{k}.cs", "GET", "/api/Order/{m}", "OrderController.Find"), ("{k}.cs", "POST", "/api/Order", "OrderController.Add"), ("{k}.cs", "PUT", "/x/{k}", "OtherController.Put"))


@query("lin-23", _CS_ROWS)
def dotnet(t: Tables) -> DataFrame:
    return lineage.dotnet(files(t, ("{k}.cs", _CS)))


@query("lin-24", f"SELECT method, url, count(*) AS n, min(path) AS first FROM ({_CS_ROWS}) GROUP BY method, url HAVING count(*) > 1")
def route_conflicts(t: Tables) -> DataFrame:
    return lineage.conflicts(dotnet(t))


_TS = """import { request } from 'umi';
export async function getOrders(p: P) {
  return request<Api.Orders>({ url: `/api/orders/{k}/`, method: 'GET', params: { a: 1 } });
}
export const saveOrder = (x) => {
  log("request");
  request({ url: '/api/save' });
  return axios({ method: "put", url: "/api/put/{m}" });
};
const q = () => { fetch('/api/inline/{k}'); };
"""
_TS_CALLS = (("getOrders", "/api/orders/{k}", "GET"), ("saveOrder", "/api/save", "POST"), ("saveOrder@8", "/api/put/{m}", "PUT"))


@query("lin-29", told("path, name, url, method", *(("s/{k}.ts", *r) for r in _TS_CALLS)))
def request_exports(t: Tables) -> DataFrame:
    return lineage.request_exports(files(t, ("s/{k}.ts", _TS)))


@query("lin-31", told("path, url, line", ("s/{k}.ts", "/api/inline/{k}", 10), ("v/{k}.vue", "/api/v", 2)))
def inline_api(t: Tables) -> DataFrame:
    return lineage.inline_calls(files(t, ("s/{k}.ts", _TS), ("v/{k}.vue", "<script>\naxios.get('/api/v/'); request.post(\"/api/second\")\n</script>")))


@query("lin-25", told("path, name, url, method", *(("s/{k}.ts", *r) for r in _TS_CALLS), ("s/{k}.ts", "{k}@10", "/api/inline/{k}", "POST")))
def react_calls(t: Tables) -> DataFrame:
    return lineage.react_calls(files(t, ("s/{k}.ts", _TS), ("b/{k}.js", _TS)))


_PAGE = """import React from 'react';
import { getOrders, saveOrder as save, never } from '@/services/apis';
export default () => { getOrders ({}); return <B onClick={() => saveOrder(1)} />; };
"""


@query("lin-26", told("page, target", ("pages/{k}.tsx", "getOrders"), ("pages/{k}.tsx", "saveOrder")))
def react_pages(t: Tables) -> DataFrame:
    made = files(t, ("s/{k}.ts", _TS), ("pages/{k}.tsx", _PAGE), ("pages/no{k}.tsx", "import { getOrders } from '@/services/apis';"))
    return lineage.react_pages(made, lineage.react_calls(made))


_VUE = """<template><a/></template>
<script>
export default { created() { axios.post('/api/vue/{k}'); } }
</script>
"""


@query("lin-27", told("path, name, url, method", ("v/Order{k}.vue", "Order{k}", None, None), ("v/Order{k}.vue", "Order{k}.vue@3", "/api/vue/{k}", "POST"), *(("s/{k}.ts", *r) for r in _TS_CALLS), ("s/{k}.ts", "{k}.ts@10", "/api/inline/{k}", "POST")))
def vue_components(t: Tables) -> DataFrame:
    parts, calls = lineage.vue_components(files(t, ("v/Order{k}.vue", _VUE), ("s/{k}.ts", _TS)))
    none = F.lit(None).cast("string")
    return parts.select("path", "name", none.alias("url"), none.alias("method")).union(calls)


_ROUTES = """const routes = [
  { path: '/orders/{k}', name: 'Orders', component: Order{k} },
  { path: '/named', name: 'Order{k}' },
  { path: '/named', name: 'again' },
  { path: 'relative', component: Other },
  { path: 'no-route' },
];
"""


@query("lin-28", told("path, route, name, component", ("r{k}.js", "/orders/{k}", "Orders", "Order{k}"), ("r{k}.js", "/named", "Order{k}", "Order{k}"), ("r{k}.js", "relative", "relative", None)))
def vue_routes(t: Tables) -> DataFrame:
    made = files(t, ("r{k}.js", _ROUTES), ("v/Order{k}.vue", _VUE))
    routes, drawn = lineage.vue_routes(made, lineage.vue_components(made)[0])
    return routes.join(drawn, ["path", "route"], "left").select("path", "route", "name", "component")


_URLS = """const BASE = '/api';
export const ORDERS = BASE + '/orders/{k}?a=';
const DEEP = ORDERS + "/x" + `/y`;
let ITEM = '/item/{0}/';
var CALL = BASE + f();
const A1 = '/a1', not_one = 1;
const HOME = 'home'; const A2 = '/a2='; const A3 = '/a3'; const A4 = '/a4#x'; const A5 = '//no'; const A6 = '/a6'; const A7 = '/a7';
"""
_CONSTS = (("BASE", "/api"), ("ORDERS", "/api/orders/{k}?a="), ("DEEP", "/api/orders/{k}?a=/x/y"), ("ITEM", "/item/{0}/"), ("HOME", "home"), ("A2", "/a2="), ("A3", "/a3"), ("A4", "/a4#x"), ("A5", "//no"), ("A6", "/a6"), ("A7", "/a7"))


@query("lin-42", told("path, name, value", *(("u/{k}.js", *r) for r in _CONSTS)))
def constants(t: Tables) -> DataFrame:
    return lineage.constants(files(t, ("u/{k}.js", _URLS)))


@query("lin-30", told("path, name, url", *(("u/{k}.js", n, u) for n, u in (("BASE", "/api"), ("ORDERS", "/api/orders/{k}"), ("DEEP", "/api/orders/{k}"), ("ITEM", "/item"), ("A2", "/a2"), ("A3", "/a3"), ("A4", "/a4"), ("A6", "/a6"), ("A7", "/a7"))), ("few/0.js", "ONE", "/one/{k}"), where="WHERE s_suppkey >= 0").replace("few/0.js", "few/declared.js"))
def url_registry(t: Tables) -> DataFrame:
    """Files with many addresses, and those that are declared."""
    made = files(t, ("u/{k}.js", _URLS), ("few/{k}.js", "const ONE = '/one/{k}';"))
    declared = files(t, ("few/declared.js", "const ONE = '/one/{k}';"))
    return lineage.url_registry(made).union(lineage.url_registry(declared, ["few/declared.js"]))


_DEPS = '{"modules": [{"source": "src/a{k}.ts", "dependencies": [{"resolved": "src/b.ts"}, {"resolved": "node_modules/x.js"}]}, {"source": "src/b.ts", "dependencies": []}, {"source": null}]}'


@query("lin-32", told("root, source, target", ("web{k}", "src/a{k}.ts", "src/b.ts"), ("web{k}", "src/a{k}.ts", None), ("web{k}", "src/b.ts", None)))
def module_graph(t: Tables) -> DataFrame:
    mods, edges = lineage.module_graph(files(t, ("web{k}", _DEPS)).select(F.col("path").alias("root"), F.col("text").alias("json")))
    return edges.union(mods.select("root", "source", F.lit(None).cast("string")))


_CALLS = """def handler{k}(x):
    service{k}(x)
    data.append(x)
def service{k}(x):
    if x: handler{k}(x)
    return repo.find{m}(x)
def find{m}(x):
    return execute("select 1")
"""
_CALL_ROWS = (("handler{k}", "service{k}"), ("service{k}", "handler{k}"), ("service{k}", "find{m}"))


@query("lin-33", told("caller, callee", *_CALL_ROWS))
def call_map(t: Tables) -> DataFrame:
    return lineage.call_map(files(t, ("{k}.py", _CALLS), ("bad{k}.py", "def (")))


@query("grf-03", told("start, name", ("handler{k}", "service{k}"), ("handler{k}", "handler{k}"), ("handler{k}", "find{m}"), ("find{m}x", "none")).replace(" UNION " + told("start, name", ("find{m}x", "none")), ""))
def name_closure(t: Tables) -> DataFrame:
    """The start is there as it is called again."""
    starts = t.supplier.select(_filled("handler{k}").alias("start"))
    return lineage.reachable_names(lineage.call_map(files(t, ("{k}.py", _CALLS))), starts)


@query("jn-08", told("source, target, confidence", ("e{k}", "f{m}", 0.8), ("e{k}", "s{k}", 0.8)))
def resolver_edges(t: Tables) -> DataFrame:
    calls = lineage.call_map(files(t, ("{k}.py", _CALLS)))
    ends = t.supplier.select(_filled("e{k}").alias("id"), _filled("handler{k}").alias("handler"))
    functions = t.supplier.select(_filled("f{m}").alias("id"), _filled("find{m}").alias("name")).distinct().union(t.supplier.select(_filled("s{k}").alias("id"), _filled("service{k}").alias("name")))
    return lineage.call_edges(ends, functions, calls, 0.8)


@query("agg-34", told("source, target, resolver", ("e{k}", "f{m}", "ast"), ("e{k}", "s{k}", "first")))
def call_edge_winner(t: Tables) -> DataFrame:
    """Of edges that several resolvers find the surest stays, of equally sure ones that of the resolver that runs first."""
    base = resolver_edges(t)
    found = base.select("source", "target", F.lit(0).alias("turn"), F.lit("first").alias("resolver"), F.when(F.startswith("target", F.lit("f")), 0.5).otherwise(0.8).alias("confidence")).union(base.select("source", "target", F.lit(1), F.lit("ast"), F.lit(0.8))).union(base.select("source", "target", F.lit(2), F.lit("late"), F.lit(0.8)))
    return lineage.first_of(found, ["source", "target"], F.desc("confidence"), "turn").select("source", "target", "resolver")


@query("agg-35", told("id, plugin, repo", ("n{m}", "a", "r0"), ("n{k}x", "a", "r1"), ("n{m}", "b", "r1")))
def multi_repo_merge(t: Tables) -> DataFrame:
    """Results of the repositories of a project: of nodes with one id of one plugin the first repository's stays."""
    row = lambda i, p, r, o: t.supplier.select(_filled(i).alias("id"), F.lit(p).alias("plugin"), F.lit(r).alias("repo"), F.lit(o).alias("turn"))
    every = row("n{m}", "a", "r0", 0).union(row("n{m}", "a", "r1", 1)).union(row("n{k}x", "a", "r1", 1)).union(row("n{m}", "b", "r1", 1))
    return lineage.first_of(every, ["plugin", "id"], "turn").select("id", "plugin", "repo")


def _handlers(t: Tables) -> tuple[DataFrame, DataFrame]:
    row = lambda *x: t.supplier.select(*(_filled(v).alias(n) if isinstance(v, str) else F.lit(v).alias(n) for v, n in x))
    ends = row(("e{k}", "id"), ("h{k}", "handler"), ("a/{k}.py", "file")).union(row(("u{k}", "id"), ("only{k}", "handler"), ("a/{k}.py", "file"))).union(row(("n{k}", "id"), ("both{k}", "handler"), ("a/{k}.py", "file")))
    symbols = row(("s1-{k}", "sid"), ("h{k}", "name"), ("b/{k}.py", "file"), (0, "ord")).union(row(("s2-{k}", "sid"), ("h{k}", "name"), ("a/{k}.py", "file"), (1, "ord"))).union(row(("s3-{k}", "sid"), ("only{k}", "name"), ("c/{k}.py", "file"), (2, "ord")))
    symbols = symbols.union(row(("s4-{k}", "sid"), ("both{k}", "name"), ("c/{k}.py", "file"), (3, "ord"))).union(row(("s5-{k}", "sid"), ("both{k}", "name"), ("d/{k}.py", "file"), (4, "ord"))).union(row(("s6-{k}", "sid"), ("write{m}", "name"), ("t{m}.py", "file"), (5, "ord")))
    return ends, symbols


@query("jn-07", told("id, sid", ("e{k}", "s2-{k}"), ("u{k}", "s3-{k}")))
def handler_lookup(t: Tables) -> DataFrame:
    """In the file of the endpoint, or the only one of its name; of several elsewhere none."""
    return lineage.find_handlers(*_handlers(t))


@query("jn-06", told("source, target, confidence", ("e{k}", "p:fn{m}", 0.7), ("u{k}", "p:fn{m}", 0.7)))
def endpoint_bridge(t: Tables) -> DataFrame:
    """Endpoints, over the calls of their handlers, to functions that touch tables."""
    ends, symbols = _handlers(t)
    calls = t.supplier.select(_filled("s2-{k}").alias("source"), _filled("s3-{k}").alias("target")).union(t.supplier.select(_filled("s3-{k}"), _filled("s6-{k}"))).union(t.supplier.select(_filled("s6-{k}"), _filled("s2-{k}")))
    functions = t.supplier.select(_filled("p:fn{m}").alias("id"), _filled("write{m}").alias("name"), _filled("t{m}.py").alias("file"), F.col("s_suppkey").alias("ord")).dropDuplicates(["id"])
    return lineage.bridge(ends, functions, symbols, calls)


def _ingested(t: Tables) -> tuple[DataFrame, DataFrame]:
    made = files(t, ("api{k}.py", '@app.post("/api/save")\ndef save{k}(x):\n    service{k}(x)\n'), ("api2{k}.py", '@app.get("/api/orders/{k}")\ndef find{k}x(x): pass\n'), ("svc{k}.py", 'def service{k}(x):\n    q("insert into t{m} values (1)")\n'), ("s/{k}.ts", _TS), ("pages/{k}.tsx", _PAGE))
    routes = lineage.fastapi(made).select(F.concat_ws(":", F.lit("p:backend_endpoint"), "method", "url").alias("id"), "handler", "url", F.col("method").alias("http_method"))
    ends = lineage.first_of(routes, ["id"], "handler")
    calls = lineage.react_calls(made)
    front = calls.select(F.concat_ws(":", F.lit("p:frontend_api_call"), "path", "name").alias("id"), "url", F.col("method").alias("http_method"), F.lit(False).alias("url_registry"), F.lit(None).cast("string").alias("service"), F.lit("").alias("operation_id"))
    access, stubs = lineage.access_edges(lineage.python_sql(made), made.select(F.col("path").alias("table")).limit(0), "p")
    functions = access.select(F.col("source").alias("id"), F.element_at(F.split("source", ":"), -1).alias("name")).distinct()
    nodes = ends.select("id").union(front.select("id")).union(functions.select("id")).union(stubs.select("id")).union(lineage.react_pages(made, calls).select(F.concat(F.lit("p:frontend_route:"), "page")).distinct())
    linked = link_calls(front, ends.select("id", "url", "http_method", F.lit(None).cast("string").alias("service"), F.lit("").alias("operation_id"))).select("source", "target", F.lit("calls_api").alias("kind"))
    called = lineage.call_edges(ends, functions, lineage.call_map(made), 0.8).select("source", "target", F.lit("calls").alias("kind"))
    return nodes.distinct(), access.select("source", "target", "kind").union(called).union(linked).distinct()


@query("lin-34", "SELECT kind, count(*) AS n FROM (" + told("kind, id", ("writes_table", "{k}"), ("calls_api", "a{k}"), ("calls_api", "b{k}"), ("calls", "c"), ("node", "p{k}"), ("node", "q"), ("node", "r{k}"), ("node", "f1{k}"), ("node", "f2{k}"), ("node", "f3{k}"), ("node", "f4{k}"), ("node", "s{k}"), ("node", "t{m}")) + ") GROUP BY kind")
def ingest(t: Tables) -> DataFrame:
    """Scanning, call resolution and linking of a whole project: how many nodes, and edges by kind. The route that all files declare is one endpoint, of the handler named first."""
    nodes, edges = _ingested(t)
    return edges.groupBy("kind").agg(F.count("*").alias("n")).union(nodes.agg(F.lit("node"), F.count("*")))
