"""Configuration files against lists written by hand."""

from weftline.operators.rules import configs


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, path string, doc string, n int").repartition(2)


def rows(items):
    return {(r.doc, r.name, r.value, r.section, r.secret, r.n) for r in configs.first_items(items).select(*configs.ITEM).collect()}


def test_json_of_any_depth(spark):
    text = '{\n "ApiKey": "abc",\n "Services": {\n  "Url": "https://api.example.gov/x",\n  "List": [1, {"Deep": {"Deeper": [true, null, 2.5]}}]\n },\n "Empty": {}, "None": null\n}'
    deep = "".join(f'{{"k{i}": ' for i in range(40)) + '"end"' + "}" * 40
    items = configs.json_items(frame(spark, text, '{"a": 1,}', "", None, "[5]", '"word"', deep))
    got = rows(items)
    assert {g for g in got if g[0] == "0"} == {
        ("0", "ApiKey", "****", None, True, 2), ("0", "Services:Url", "https://api.example.gov/x", "Services", False, 4), ("0", "Services:List:0", "1", "Services", False, 1),
        ("0", "Services:List:1:Deep:Deeper:0", "true", "Services", False, 1), ("0", "Services:List:1:Deep:Deeper:2", "2.5", "Services", False, 1),
    }
    assert {g[:3] for g in got if g[0] != "0"} == {("4", "0", "5"), ("6", ":".join(f"k{i}" for i in range(40)), "end")}
    assert {(r.source, r.target) for r in configs.item_links(configs.first_items(items)).collect()} == {("Services:Url", "external_system:api.example.gov")}


def test_properties_and_sections(spark):
    text = "# note\nname = x = y\n[db]\npassword: s3cret\nurl=jdbc:oracle:thin:@host:1521/PAYDB?x=1\n; note\nconn=Server=h1;Initial Catalog=Pay;Password=pw9;\n[log]\npassword=\nnothing here\n"
    items = configs.property_items(frame(spark, text, "", None))
    assert rows(items) == {
        ("0", "name", "x = y", None, False, 2), ("0", "password", "****", "db", True, 4), ("0", "url", "jdbc:oracle:thin:@host:1521/PAYDB?x=1", "db", False, 5),
        ("0", "conn", "Server=h1;Initial Catalog=Pay;Password=****;", "db", True, 7), ("0", "password", "", "log", False, 9),
    }
    links = {(r.source, r.target): r.attrs for r in configs.item_links(configs.first_items(items)).collect()}
    assert set(links) == {("url", "data_store:PAYDB"), ("conn", "data_store:PAY")} and "pw9" not in str(links)


WEB = """<?xml version="1.0"?>
<!-- <add key="no" value="no"/> -->
<configuration xmlns="urn:x">
  <connectionStrings>
    <add name="Pay"
         connectionString="Data Source=h;Initial Catalog=PayDb;pwd=p1" />
  </connectionStrings>
  <appSettings>
    <add key="Rate" value="71 &amp; more"/>
    <add key="SmtpPassword" value='x'/>
  </appSettings>
  <client><endpoint address="net.tcp://bus01:80/x" contract="IBus"/></client>
  <a><a><a>deep</a></a></a>
</configuration>
"""
SERVLETS = "<web-app><context-param>\n<param-name>mode</param-name><param-value>live</param-value></context-param>\n<servlet><servlet-name>s</servlet-name><servlet-class>org.x.Look</servlet-class></servlet>\n<servlet-mapping><servlet-name>s</servlet-name>\n<url-pattern>/look</url-pattern></servlet-mapping></web-app>"


def test_xml(spark):
    broken = ["<a><b></a></b>", "<a>", "<a/><b/>", "text <a/>" and "<a></a> tail", "</a>", "no xml", ""]
    elements = configs.xml_elements(frame(spark, WEB, SERVLETS, *broken))
    got = elements.collect()
    assert {r.doc for r in got} == {"0", "1"}
    own = {(r.path, r.n, r.depth) for r in got if r.doc == "0"}
    assert own >= {("configuration", 3, 1), ("configuration/connectionStrings/add", 5, 3), ("configuration/appSettings/add", 9, 3), ("configuration/a/a/a", 13, 4)} and len(own) == 11
    assert [r.body for r in got if r.path == "configuration/a/a/a"] == ["deep"]
    items = configs.first_items(configs.xml_items(elements))
    assert rows(configs.xml_items(elements)) == {
        ("0", "Pay", "Data Source=h;Initial Catalog=PayDb;pwd=****", "connectionStrings", True, 5), ("0", "Rate", "71 & more", "appSettings", False, 9), ("0", "SmtpPassword", "****", "appSettings", True, 10),
        ("0", "IBus", "net.tcp://bus01:80/x", "serviceModel", False, 12), ("1", "mode", "live", "context-param", False, 2),
    }
    assert {(r.source, r.target) for r in configs.item_links(items).collect()} == {("Pay", "data_store:PAYDB"), ("IBus", "external_system:bus01")}
    assert {(r.source, r.target, r.n) for r in configs.servlet_routes(elements).collect()} == {("ANY /look", "class:Look", 5)}
