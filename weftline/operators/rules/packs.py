"""Language packs: comment stripping (F9), choice of a pack (X7, X1), units and relations (X6), structure (X16), links.

A pack is data. The engine is one set of column expressions and joins over (document, line) rows:
comments are blanked in whole texts with line numbers kept, units are found line by line, each line
belongs to the last unit that started before it, and what a line calls, includes, reads, writes or
shows becomes a relation of that unit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.brackets import counted
from weftline.staging import dealt, stage

ID = r"([A-Za-z_][\w$#@-]*)"
WORD = r"([\w$#@./-]+)"

# How languages mark strings, block comments and line comments (regular expressions).
ESCAPED = r'"(?:[^"\\\n]++|\\[^\n])*+"?|\'(?:[^\'\\\n]++|\\[^\n])*+\'?'
DOUBLED = r'"[^"\n]*+"?|\'[^\'\n]*+\'?'
DOUBLE_ONLY = r'"[^"\n]*+"?'
SINGLE_ONLY = r"'[^'\n]*+'?"
C_BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"
STYLES: dict[str, tuple[str, str, str]] = {
    "c": (ESCAPED, C_BLOCK, r"//[^\n]*"),
    "cl": (SINGLE_ONLY, C_BLOCK, ""),
    "sql": (DOUBLED, C_BLOCK, r"--[^\n]*"),
    "dashes": (DOUBLED, "", r"--[^\n]*"),
    "script": (ESCAPED, "", r"(?<![\w$\"'])#[^\n]*"),
    "php": (ESCAPED, C_BLOCK, r"//[^\n]*|#[^\n]*"),
    "vb": (DOUBLE_ONLY, "", r"'[^\n]*|(?i:(?<![\w.])rem\b)[^\n]*"),
    "batch": (DOUBLE_ONLY, "", r"(?im:^\s*@?rem\b)[^\n]*|(?m:^\s*::)[^\n]*"),
    "powershell": (DOUBLED, r"<#[\s\S]*?(?:#>|\z)", r"#[^\n]*"),
    "star": (DOUBLED, "", r"(?m:^\s*\*)[^\n]*|(?m:^.{6}[*/])[^\n]*|\*>[^\n]*"),
    "natural": (DOUBLED, "", r"(?m:^\s*\*)[^\n]*|/\*[^\n]*"),
    "sas": (DOUBLED, C_BLOCK, r"(?m:^\s*\*)[^;\n]*;?"),
    "pascal": (SINGLE_ONLY, r"\{[^}]*(?:\}|\z)|\(\*[\s\S]*?(?:\*\)|\z)", r"//[^\n]*"),
    "foxpro": (DOUBLED, "", r"(?m:^\s*\*)[^\n]*|&&[^\n]*"),
    "fourgl": (ESCAPED, r"\{[^}]*(?:\}|\z)", r"#[^\n]*|--[^\n]*"),
    "bang": (DOUBLED, "", r"![^\n]*"),
    "markup": ("", r"<!--(?!\[if)[\s\S]*?(?:-->|\z)|<%--[\s\S]*?(?:--%>|\z)", ""),
    "coldfusion": ("", r"<!---[\s\S]*?(?:--->|\z)", ""),
    "props": ("", "", r"(?m:^\s*[#;!])[^\n]*"),
    "none": ("", "", ""),
}


def stripped(text: Column, style: str) -> Column:
    """the text with its comments as blanks (block comments, line ends kept) or left out (to the line's end); strings stay."""
    strings, block, line = STYLES[style]
    pattern = "|".join(f"(?:{p})" for p in (strings, block, line) if p)
    if not pattern:
        return text
    is_string = F.lit(False) if not strings else F.lit(True)

    def clean(hit: Column) -> Column:
        out = F.lit("")
        if block:
            out = F.when(hit.rlike(rf"\A(?:{block})\z"), F.regexp_replace(hit, r"[^\n]", " ")).otherwise(out)
        return F.when(is_string & hit.rlike(rf"\A(?:{strings})\z"), hit).otherwise(out) if strings else out

    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda piece, hit: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(clean(hit), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(both, "")).otherwise(text)


@dataclass(frozen=True)
class Pack:
    """One language. Patterns hold the name in their first group; they are tried without case unless `cased`."""

    extensions: tuple[str, ...]
    names: tuple[str, ...]
    signs: tuple[str, ...]
    comments: str
    units: tuple[tuple[str, str], ...]
    relations: tuple[tuple[str, str, str], ...]
    cased: bool = False
    upper: bool = False


SQL_USE = (("reads", "table", r"\b(?:from|join)\s+([A-Za-z_][\w.$#]*)"), ("writes", "table", r"\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+([A-Za-z_][\w.$#]*)"))
VB_UNITS = (("function", rf"^\s*(?:(?:public|private|friend|protected|shared|static)\s+)*(?:sub|function|property\s+(?:get|let|set))\s+{ID}"), ("class", rf"^\s*(?:(?:public|private|friend|partial)\s+)*(?:class|module|structure|interface)\s+{ID}"))
VB_CALL = ("calls", "function", rf"^\s*call\s+{ID}")

# The syntax of languages, as far as units and relations show in single lines.
PACKS: dict[str, Pack] = {
    "vb6": Pack(("frm", "ctl", "vbp", "dsr"), ("visual basic 6", "vb6", "visual basic"), (r"^attribute vb_name", r"^version 5\.00", r"on error (?:goto|resume)", r"\bdim \w+ as\b"), "vb", VB_UNITS, (VB_CALL, ("uses", "external_system", r'createobject\(\s*"([\w.]+)"'), ("navigates_to", "screen", r"\b(frm\w+)\.show\b"))),
    "vba": Pack(("bas", "cls"), ("vba", "access vba", "excel vba"), (r"\bdocmd\.", r"\bcurrentdb\b", r"\bforms!", r"\bthisworkbook\b"), "vb", VB_UNITS, (VB_CALL, ("navigates_to", "screen", r'docmd\.openform\s+"([^"]+)"'), ("reads", "table", r'openrecordset\(\s*"(\w+)"'))),
    "vbnet": Pack(("vb",), ("vb.net", "visual basic .net"), (r"^\s*imports\s+system", r"^\s*end\s+(?:module|class|namespace)", r"\bhandles\s+\w+\.\w+"), "vb", VB_UNITS, (VB_CALL, ("inherits", "class", r"^\s*inherits\s+([\w.]+)"), ("includes", "module", r"^\s*imports\s+([\w.]+)"), ("uses", "class", rf"\bnew\s+{ID}\s*\("))),
    "vbscript": Pack(("vbs", "asp", "inc", "wsf"), ("vbscript", "classic asp", "asp"), (r"<%", r"server\.createobject", r"response\.write", r"wscript\."), "vb", VB_UNITS[:1], (VB_CALL, ("uses", "external_system", r'createobject\(\s*"([\w.]+)"'), ("navigates_to", "screen", r'response\.redirect\s*\(?\s*"([\w./]+)'), ("includes", "file", r'#include\s+(?:file|virtual)\s*=\s*"([^"]+)"'))),
    "rpg": Pack(("rpg", "rpgle", "sqlrpgle", "rpg38", "rpg36"), ("rpg", "rpgle", "rpg iv", "ile rpg"), (r"\*\*free", r"\bdcl-(?:s|ds|proc|f)\b", r"\b(?:begsr|endsr|exsr|chain|setll)\b"), "c", (("paragraph", rf"\bbegsr\s+{ID}"), ("paragraph", r"^.{5}C\s+([A-Z][\w#@$]*)\s+begsr\b"), ("function", rf"\bdcl-proc\s+{ID}")), (("calls", "paragraph", rf"\bexsr\s+{ID}"), ("calls", "program", r"\bcallp?\s+'?([A-Z][\w#@$]*)'?"), ("includes", "copybook", r"/(?:copy|include)\s+([\w/,]+)"), ("reads", "file", r"\b(?:chain|reade?|setll)\s*(?:\(\w\))?\s+(?:\w+\s+)?([A-Z][\w#@$]*)\s*;?\s*$"), ("writes", "file", r"\b(?:write|update|delete)\s+([A-Z][\w#@$]*)\s*;?\s*$"), ("displays", "screen", r"\bexfmt\s+(\w+)")), upper=True),
    "cl": Pack(("clp", "clle", "cl", "cmd"), ("cl", "clle", "control language"), (r"^\s*pgm\b", r"\bdcl\s+var\(", r"\bcall\s+pgm\(", r"\bendpgm\b"), "cl", (("paragraph", r"^\s*([A-Z][\w#@$]*):"),), (("calls", "program", r"\bcall\s+pgm\((?:\w+/)?([A-Z][\w#@$]*)\)"), ("calls", "paragraph", r"\bgoto\s+cmdlbl\((\w+)\)"), ("uses", "file", r"\b(?:ovrdbf|dclf)\s+file\((?:\w+/)?(\w+)\)"), ("reads", "file", r"\bfromfile\((?:\w+/)?(\w+)\)"), ("writes", "file", r"\btofile\((?:\w+/)?(\w+)\)")), upper=True),
    "natural": Pack(("nsp", "nsn", "nss", "nsl", "nsm", "nsc", "nsg", "nsh", "nat"), ("natural",), (r"\bdefine data\b", r"\bend-define\b", r"\bcallnat\b"), "natural", (("paragraph", r"\bdefine\s+subroutine\s+([\w#-]+)"),), (("calls", "program", r"\b(?:callnat|fetch(?:\s+return)?|call)\s+'([\w#-]+)'"), ("calls", "paragraph", r"\bperform\s+([\w#-]+)"), ("includes", "copybook", r"\b(?:local|parameter|global)\s+using\s+([\w#-]+)"), ("reads", "file", r"\b(?:read|find|histogram)\s+([A-Z][\w-]*)\s+(?:by|with)\b"), ("displays", "screen", r"\busing\s+map\s+'([\w#-]+)'")), upper=True),
    "pli": Pack(("pli", "pl1", "plinc", "pl", "inc"), ("pl/i", "pli", "pl1"), (r"\bproc(?:edure)?\s+options\s*\(\s*main", r"\bdcl\s+\w+\s+(?:fixed|char|bit)", r"\bput\s+(?:skip|list|edit)"), "cl", (("function", r"^\s*([A-Z][\w#@$]*)\s*:\s*proc(?:edure)?\b"),), (("calls", "function", r"\bcall\s+([A-Z][\w#@$]*)"), ("includes", "copybook", r"%include\s+(\w+)"), ("reads", "file", r"\bread\s+file\s*\((\w+)\)"), ("writes", "file", r"\b(?:re)?write\s+file\s*\((\w+)\)")), upper=True),
    "asm": Pack(("asm", "mac", "mlc", "hlasm", "s"), ("assembler", "hlasm", "bal", "assembly", "assembly language", "ibm assembler"), (r"\bcsect\b", r"\b(?:stm|balr|bas|using)\s", r"\bdc\s+[cfhx]['\d]"), "star", (("function", r"^([A-Z@#$]\w{0,7})\s+(?:csect|start|dsect)\b"),), (("calls", "program", r"\bcall\s+([A-Z@#$]\w*)"), ("calls", "program", r"=v\((\w+)\)"), ("includes", "copybook", r"^\s+copy\s+(\w+)")), upper=True),
    "rexx": Pack(("rex", "rexx", "exec"), ("rexx",), (r"/\*\s*rexx", r"\bparse\s+(?:arg|pull|var|upper)\b", r"\baddress\s+(?:tso|ispexec|mvs)\b"), "c", (("function", rf"^\s*{ID}:\s*(?:procedure)?"),), (("calls", "function", rf"\bcall\s+{ID}"), ("displays", "screen", r"\bdisplay\s+panel\((\w+)\)"))),
    "clist": Pack(("clist", "clst"), ("clist",), (r"^\s*proc\s+\d", r"\bset\s+&?\w+\s*=", r"\bcontrol\s+(?:list|nolist|msg)"), "cl", (("function", r"^\s*(\w+):\s*(?:do|subproc)?\b"),), (("calls", "program", r"%(\w+)"), ("calls", "program", r"\bcall\s+'([^']+)'")), upper=True),
    "easytrieve": Pack(("ezt", "eztrieve", "ezy", "eztp"), ("easytrieve", "easytrieve plus"), (r"^\s*job\s+input\b", r"^\s*parm\b", r"^\s*report\s+\w+"), "star", (("paragraph", r"^\s*([A-Z][\w-]*)\.?\s+proc\b"),), (("calls", "paragraph", r"\bperform\s+([\w-]+)"), ("reads", "file", r"\bjob\s+input\s+\(?(\w+)"), ("includes", "copybook", r"^\s*%(\w+)")), upper=True),
    "sas": Pack(("sas",), ("sas",), (r"^\s*data\s+\w+", r"^\s*proc\s+\w+", r"^\s*run\s*;", r"%macro\b"), "sas", (("function", rf"%macro\s+{ID}"), ("paragraph", r"^\s*proc\s+(\w+)")), (("calls", "function", r"%(?!macro|mend|let|if|do|end|else|include|put|then|to)(\w+)\s*[(;]"), ("includes", "file", r"%include\s+[\"']([^\"']+)"), ("reads", "table", r"^\s*(?:set|merge)\s+([\w.]+)"), ("writes", "table", r"^\s*data\s+([\w.]+)"))),
    "plsql": Pack(("pks", "pkb", "pls", "prc", "fnc", "trg", "plsql", "plb"), ("pl/sql", "plsql", "oracle"), (r"\bcreate\s+or\s+replace\s+(?:package|procedure|function)", r"\bexception\s+when\b", r"%(?:row)?type\b"), "sql", (("function", r"\b(?:procedure|function)\s+([\w.$#]+)"), ("class", r"\bpackage\s+(?:body\s+)?([\w.$#]+)")), SQL_USE),
    "tsql": Pack(("tsql",), ("t-sql", "tsql", "transact-sql", "sql server"), (r"\bcreate\s+proc(?:edure)?\b", r"\bdeclare\s+@\w+", r"^\s*go\s*$", r"\bset\s+nocount\b"), "sql", (("function", r"\b(?:create|alter)\s+(?:proc(?:edure)?|function)\s+([\w.\[\]]+)"),), (("calls", "function", r"\bexec(?:ute)?\s+([A-Za-z_][\w.]*)"), *SQL_USE)),
    "powerbuilder": Pack(("srw", "sru", "srd", "srm", "srf", "srs", "sra", "srj"), ("powerbuilder", "powerscript"), (r"^\s*global type\b", r"^\s*end type\b", r"\btriggerevent\b"), "c", (("class", r"^\s*global\s+type\s+(\w+)"), ("function", r"^\s*(?:public|private|protected)\s+(?:function|subroutine)\s+(?:\w+\s+)?(\w+)\s*\("), ("function", r"^\s*event\s+(\w+)")), (("navigates_to", "screen", r"\bopen(?:sheet)?\s*\(\s*(w_\w+)"), ("uses", "table", r"\bdataobject\s*=\s*\"(\w+)\""), ("reads", "table", r"\bselect\b.*\bfrom\s+(\w+)"), SQL_USE[1])),
    "coldfusion": Pack(("cfm", "cfc", "cfml"), ("coldfusion", "cfml"), (r"<cf(?:query|output|set|component|function)\b", r"#\w+\.\w+#", r"</cf\w+>"), "coldfusion", (("function", r'<cffunction\b[^>]*\bname\s*=\s*"([^"]+)"'), ("class", r'<cfcomponent\b[^>]*\bname\s*=\s*"([^"]+)"')), (("includes", "file", r'<cfinclude\b[^>]*\btemplate\s*=\s*"([^"]+)"'), ("uses", "data_store", r'\bdatasource\s*=\s*"([^"]+)"'), ("navigates_to", "screen", r'<cflocation\b[^>]*\burl\s*=\s*"([^"?]+)'), *SQL_USE)),
    "php": Pack(("php", "php3", "php4", "php5", "phtml"), ("php",), (r"<\?php", r"\$\w+\s*=", r"\becho\b", r"->\w+\("), "php", (("function", rf"\bfunction\s+{ID}\s*\("), ("class", rf"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+{ID}")), (("includes", "file", r"\b(?:include|require)(?:_once)?\s*\(?\s*[\"']([^\"']+)"), ("uses", "class", rf"\bnew\s+{ID}"), ("inherits", "class", rf"\bextends\s+{ID}"))),
    "perl": Pack(("pl", "pm", "cgi", "t"), ("perl",), (r"^\s*use\s+strict", r"\bmy\s+[$@%]\w+", r"^\s*sub\s+\w+", r"=~"), "script", (("function", rf"^\s*sub\s+{ID}"), ("class", r"^\s*package\s+([\w:]+)")), (("includes", "module", r"^\s*(?:use|require)\s+([A-Z][\w:]*)"), ("calls", "function", rf"&{ID}\s*\("))),
    "shell": Pack(("sh", "ksh", "bash", "csh"), ("shell", "bash", "ksh", "sh"), (r"^#!.*\b(?:ba|k|z)?sh\b", r"\bfi\b", r"\bdone\b", r"\bexport\s+\w+="), "script", (("function", rf"^\s*(?:function\s+)?{ID}\s*\(\)"), ("function", rf"^\s*function\s+{ID}")), (("includes", "file", r"^\s*(?:source|\.)\s+(\S+)"), ("calls", "program", r"\b(?:sh|ksh|bash)\s+([\w./-]+\.k?sh)"), ("uses", "program", r"\b(sqlplus|isql|bteq|db2|sqlldr)\b")), cased=True),
    "batch": Pack(("bat", "cmd"), ("batch", "windows batch", "cmd"), (r"^\s*@?echo\s+off", r"\bgoto\s+:?\w+", r"%\w+%", r"\bset\s+\w+="), "batch", (("paragraph", r"^\s*:([A-Za-z]\w*)"),), (("calls", "paragraph", r"\b(?:goto|call)\s+:(\w+)"), ("calls", "program", r"\bcall\s+(?!:)([\w.\\/-]+)"))),
    "powershell": Pack(("ps1", "psm1", "psd1"), ("powershell",), (r"\$\w+\s*=", r"\b(?:get|set|new|invoke)-\w+", r"\bparam\s*\("), "powershell", (("function", rf"^\s*function\s+{ID}"),), (("includes", "module", r"\bimport-module\s+([\w.-]+)"), ("calls", "program", r"\binvoke-(?:expression|command)\s+(\S+)"))),
    "python": Pack(("py", "pyw"), ("python", "python 2", "python 3"), (r"^\s*def\s+\w+\(.*\):", r"^\s*(?:from\s+\S+\s+)?import\s", r"^\s*class\s+\w+.*:", r"\bself\."), "script", (("function", rf"^\s*(?:async\s+)?def\s+{ID}"), ("class", rf"^\s*class\s+{ID}")), (("includes", "module", r"^\s*(?:from|import)\s+([\w.]+)"), ("inherits", "class", r"^\s*class\s+\w+\(([A-Za-z_][\w.]*)")), cased=True),
    "javascript": Pack(("js", "jsx", "mjs", "ts", "tsx"), ("javascript", "js", "typescript", "node"), (r"\bfunction\s*\w*\(", r"=>", r"\b(?:const|let|var)\s+\w+\s*=", r"\brequire\("), "c", (("class", rf"\bclass\s+{ID}"), ("function", rf"\bfunction\s+{ID}\s*\("), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{ID}\s*=\s*(?:async\s*)?\(?[\w,\s]*\)?\s*=>")), (("includes", "module", r"\b(?:require\(\s*|from\s+)[\"']([^\"']+)"), ("inherits", "class", rf"\bextends\s+{ID}"), ("uses", "external_system", r"\bfetch\(\s*[\"']([^\"']+)")), cased=True),
    "delphi": Pack(("pas", "dpr", "dpk", "inc", "dfm"), ("delphi", "pascal", "object pascal"), (r"^\s*unit\s+\w+;", r"^\s*uses\b", r"\bbegin\b", r"^\s*(?:procedure|function)\b"), "pascal", (("function", r"^\s*(?:procedure|function|constructor|destructor)\s+([\w.]+)"), ("class", r"^\s*(\w+)\s*=\s*class\b")), (("includes", "module", r"^\s*uses\s+([\w.]+)"), ("navigates_to", "screen", r"\b(\w+)\.showmodal\b"))),
    "foxpro": Pack(("prg", "spr", "mpr", "qpr", "scx"), ("foxpro", "visual foxpro", "vfp"), (r"^\s*procedure\b", r"\bset\s+(?:talk|exact|deleted)\s", r"\b(?:scan|endscan|seek|replace)\b"), "foxpro", (("function", rf"^\s*(?:procedure|function)\s+{ID}"),), (("calls", "function", rf"^\s*do\s+{ID}"), ("uses", "table", r"^\s*use\s+(\w+)"), ("displays", "screen", r"\bdo\s+form\s+(\w+)"))),
    "informix4gl": Pack(("4gl", "4gs", "per"), ("informix 4gl", "4gl"), (r"^\s*main\s*$", r"^\s*end\s+(?:main|function|report)", r"\bdefine\s+\w+\s+(?:like|record)"), "fourgl", (("function", rf"^\s*(?:function|report)\s+{ID}"),), (("calls", "function", rf"\bcall\s+{ID}\s*\("), ("displays", "screen", r"\bopen\s+(?:form|window)\s+(\w+)"), *SQL_USE)),
    "progress": Pack(("p", "w", "i", "cls"), ("progress", "openedge", "abl", "progress 4gl"), (r"\bdefine\s+variable\b", r"\bfor\s+each\b", r"\bno-lock\b", r"\bend\s+procedure\b"), "cl", (("function", rf"^\s*(?:procedure|function)\s+([\w-]+)"),), (("calls", "function", r"\brun\s+([\w./-]+)"), ("reads", "table", r"\b(?:for\s+each|find\s+(?:first|last)?)\s*(\w+)"), ("writes", "table", r"^\s*(?:create|delete|assign)\s+(\w+)"), ("includes", "file", r"\{([\w./-]+\.i)"))),
    "fortran": Pack(("f", "f77", "f90", "f95", "for"), ("fortran",), (r"^\s*program\s+\w+", r"^\s*(?:subroutine|end\s*subroutine)\b", r"\bimplicit\s+none\b"), "bang", (("function", rf"^\s*(?:\w+\s+)?(?:subroutine|function|program)\s+{ID}"), ("class", rf"^\s*module\s+(?!procedure){ID}")), (("calls", "function", rf"\bcall\s+{ID}"), ("includes", "module", rf"^\s*use\s+{ID}"))),
    "basic": Pack(("bas0", "gwb", "qb"), ("basic", "quickbasic"), (r"^\s*\d+\s+(?:print|let|goto|rem)\b", r"\bgosub\b", r"\bnext\s+\w+"), "vb", (("function", rf"^\s*(?:\d+\s+)?(?:sub|function|def\s+fn)\s*{ID}"),), (("calls", "function", rf"\bcall\s+{ID}"),)),
}
# How a unit ends, by pack: a pattern for a kind of unit, or the scope of braces or of indents.
VB_ENDS = {"function": r"^\s*end\s+(?:sub|function|property)\b", "class": r"^\s*end\s+(?:class|module|structure|interface)\b"}
ENDS: dict[str, dict[str, str]] = {
    "vb6": VB_ENDS,
    "vba": VB_ENDS,
    "vbnet": VB_ENDS,
    "vbscript": VB_ENDS,
    "rpg": {"paragraph": r"\bendsr\b", "function": r"\bend-proc\b|^.{5}p\s+.*\be\b"},
    "natural": {"paragraph": r"\bend-subroutine\b"},
    "pli": {"function": r"^\s*end\s+[a-z0-9_#@$]+\s*;"},
    "easytrieve": {"paragraph": r"\bend-proc\b"},
    "sas": {"function": r"%mend\b"},
    "powerbuilder": {"function": r"^\s*end\s+(?:event|function|subroutine)\b"},
    "coldfusion": {"function": r"</cffunction>|^\s*\}\s*$"},
    "foxpro": {"function": r"^\s*(?:endproc|endfunc|return)\b"},
    "informix4gl": {"function": r"^\s*end\s+(?:function|report|main)\b"},
    "progress": {"function": r"^\s*end\s+(?:procedure|function)\b"},
}
BRACED, INDENTED = ("php", "perl", "shell", "powershell", "javascript"), ("python",)
UNIT_KINDS = ("function", "class", "paragraph")
OTHER_FORMATS = {"sql": ("sql", "ddl"), "markup": ("html", "htm", "xml", "aspx", "jsp", "xhtml"), "props": ("properties", "ini", "cfg", "conf"), "java": ("java",), "csharp": ("cs",), "c": ("c", "h", "cpp", "hpp")}
#: The comment style of documents that no pack covers.
OTHER_STYLES = {"sql": "sql", "markup": "markup", "props": "props", "java": "c", "csharp": "c", "c": "c"}
LEAST_SIGNS = 3


def _all(text: Column | str, pattern: str, cased: bool) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern if cased else f"(?i){pattern}"), F.lit(1))


def _hits(pattern: str, cased: bool, kind: str, target_kind: str) -> Column:
    return F.transform(_all("line", pattern, cased), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(target_kind).alias("target_kind"), x.alias("name")))


def packed(docs: DataFrame, name: str = "name", language: str = "language", text: str = "text") -> DataFrame:
    """The documents with pack and by: by the name's extension (of languages that share it, by their signs), else by the stated language, else by at least `LEAST_SIGNS` signs in the text.

    Every matching line of a sign counts once; the pack with most signs wins, then the first by name.
    Documents that none fits have no pack. Only texts that the first two do not settle are searched.
    """
    of_extension: dict[str, list[str]] = {e: [kind] for kind, es in OTHER_FORMATS.items() for e in es}
    for pack, p in PACKS.items():
        for e in p.extensions:
            of_extension.setdefault(e, []).append(pack)
    of_name = {n: pack for pack, p in reversed(PACKS.items()) for n in p.names}
    look = lambda table, value: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    one = look({e: packs[0] for e, packs in of_extension.items() if len(packs) == 1}, extension)
    by_language = look(of_name, F.lower(F.trim(F.coalesce(language, F.lit("")))))
    counts = F.array(*[F.struct(sum((F.size(F.regexp_extract_all(text, F.lit(f"(?im){s}"), F.lit(0))) for s in p.signs), F.lit(0)).alias("n"), F.lit(-at).alias("order"), F.lit(pack).alias("pack")) for at, (pack, p) in enumerate(PACKS.items())])
    best = F.array_max(F.filter(counts, lambda c: c["n"] >= LEAST_SIGNS))
    shared = F.lit(None)
    for e, packs in of_extension.items():  # of the languages that share an extension the one with most signs, then the first
        if len(packs) > 1:
            most = F.array_max(F.array(*[F.get(counts, list(PACKS).index(pack)) for pack in packs]))
            shared = F.when(extension == e, most["pack"]).otherwise(shared)
    by_extension = F.coalesce(one, shared)
    settled = F.coalesce(by_extension, by_language)
    by_signs = F.when(settled.isNull(), best["pack"])
    how = F.when(by_extension.isNotNull(), "extension").when(by_language.isNotNull(), "language").when(by_signs.isNotNull(), "signs")
    return docs.withColumns({"pack": F.coalesce(settled, by_signs), "by": how})


def chosen(docs: DataFrame, key: str = "doc_id", name: str = "name", language: str = "language", text: str = "text") -> DataFrame:
    """(key, pack, by) of documents, as `packed` chooses."""
    return packed(docs, name, language, text).select(key, "pack", "by")


def stripped_documents(docs: DataFrame, key: str = "doc_id", pack: str = "pack", text: str = "text") -> DataFrame:
    """F9 over documents with a pack column: (key, pack, text)."""
    return docs.select(key, pack, _bare(pack, text).alias("text"))


def _bare(pack: str, text: str) -> Column:
    """The text without comments, by the style of its pack."""
    styles: dict[str, list[str]] = {}
    for name, style in ({name: p.comments for name, p in PACKS.items()} | OTHER_STYLES).items():
        styles.setdefault(style, []).append(name)
    body = F.col(text)
    for style, names in styles.items():
        body = F.when(F.col(pack).isin(*names), stripped(F.col(text), style)).otherwise(body)
    return body


SPAN_BUCKET = 64


def _shape() -> list[Column]:
    """What a line tells of the ends of units: its braces, its indent, and the kinds that it ends."""
    line = F.col("line")
    ends = []
    for kind in UNIT_KINDS:
        found = F.lit(False)
        for pack, patterns in ENDS.items():
            if kind in patterns:
                found = F.when(F.col("pack") == pack, line.rlike(f"(?i){patterns[kind]}")).otherwise(found)
        ends.append(F.when(found, F.lit(kind)))
    indent = F.when(F.trim(F.regexp_replace(line, r"\s", "")) != "", F.length(F.regexp_extract(line, r"^(\s*)", 1)))
    return [counted(line, "{").alias("opens"), counted(line, "}").alias("closes"), indent.alias("indent"), F.array_compact(F.array(*ends)).alias("ends")]


def unit_spans(rows: DataFrame) -> DataFrame:
    """(key, name, kind, low, high): the lines of each unit of rows with their shape; the name as it is written."""
    order = W.partitionBy("key").orderBy("n")
    later = order.rowsBetween(1, W.unboundedFollowing)
    first = lambda when: F.first(F.when(when, F.col("n")), ignorenulls=True).over(later)
    after = F.sum(F.col("opens") - F.col("closes")).over(order)
    placed = rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("opens") + F.col("closes"))
    placed = placed.withColumns({f"end_{k}": first(F.array_contains("ends", k)) for k in UNIT_KINDS} | {"last": F.max("n").over(W.partitionBy("key"))})
    units = placed.where("unit IS NOT NULL").select("key", "pack", "n", F.col("unit.kind").alias("kind"), F.col("unit.name").alias("name"), "opens", "before", "after", "indent", "last", *[f"end_{k}" for k in UNIT_KINDS])
    by_word = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"end_{k}")) for k in UNIT_KINDS])

    def closing(events: DataFrame, asked: DataFrame) -> DataFrame:
        """The first event of the unit's level at or behind it: events key, level, n; asked key, level, n."""
        both = events.select("key", "level", "n", F.col("n").alias("at")).unionByName(asked.select("key", "level", "n", F.lit(None).cast("int").alias("at")))
        ahead = W.partitionBy("key", "level").orderBy("n").rangeBetween(W.currentRow, W.unboundedFollowing)
        return both.withColumn("shut", F.min("at").over(ahead)).where("at IS NULL").select("key", "n", "shut").distinct()

    # a brace closes the levels between the depths around it; a pair on one line the level above the line
    braced = placed.where(F.col("pack").isin(*BRACED) & (F.col("closes") > 0))
    top = F.col("before") + F.when((F.col("opens") > 0) & (F.col("after") >= F.col("before")), 1).otherwise(0)
    events = braced.where(F.col("after") + 1 <= top).select("key", "n", F.explode(F.sequence(F.col("after") + 1, top)).alias("level"))
    by_brace = closing(events, units.where(F.col("pack").isin(*BRACED)).select("key", "n", (F.col("before") + 1).alias("level")))
    # a written line closes the units of its own indent and deeper ones, on the line before it
    indents = units.where(F.col("pack").isin(*INDENTED)).groupBy("key").agg(F.collect_set("indent").alias("levels"))
    outer = placed.where(F.col("pack").isin(*INDENTED) & F.col("indent").isNotNull()).join(indents, "key")
    shut = outer.select("key", (F.col("n") - 1).alias("n"), F.explode(F.filter("levels", lambda x: x >= F.col("indent"))).alias("level"))
    by_indent = closing(shut, units.where(F.col("pack").isin(*INDENTED)).select("key", "n", F.col("indent").alias("level"))).withColumnRenamed("shut", "indent_end")
    ended = units.join(by_brace, ["key", "n"], "left").join(by_indent, ["key", "n"], "left")
    following = W.partitionBy("key").orderBy("n").rowsBetween(1, W.unboundedFollowing)
    next_any = F.first(F.when(F.col("kind").isin("function", "class"), F.col("n") - 1), ignorenulls=True).over(following)
    next_paragraph = F.first(F.when(F.col("kind").isin("function", "class", "paragraph"), F.col("n") - 1), ignorenulls=True).over(following)
    follows = F.when(F.col("kind") == "paragraph", next_paragraph).otherwise(next_any)
    high = F.coalesce(by_word, "shut", F.when(F.col("pack").isin(*INDENTED), F.coalesce("indent_end", "last")), follows, "last")
    return ended.select("key", "name", "kind", F.col("n").alias("low"), F.greatest(high, "n").alias("high"))


def extracted(docs: DataFrame, key: str = "doc_id", pack: str = "pack", name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of documents with a pack.

    entities: key, kind, name, parent, n (the line); each document is a program by its name without
    folder and extension, and the parent of its units. relations: key, kind, source, target_kind,
    target, n; the source is the last unit that started at or before the line, else the program.
    """
    upper = [p for p, spec in PACKS.items() if spec.upper]
    cased = lambda value: F.when(F.col("pack").isin(*upper), F.upper(value)).otherwise(value)
    stem = F.regexp_extract(F.col(name), r"([^/\\.]+)(?:\.[^/\\]*)?$", 1)
    held = docs.where(F.col(pack).isin(*PACKS)).select(F.col(key).alias("key"), F.col(pack).alias("pack"), stem.alias("program"), F.coalesce(_bare(pack, text), F.lit("")).alias("text"))
    rows = held.select("key", "pack", "program", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    none = F.array().cast("array<struct<kind:string,target_kind:string,name:string>>")
    units, used = none, none
    for pack_name, spec in PACKS.items():
        here = F.col("pack") == pack_name
        unit = F.flatten(F.array(*[_hits(pattern, spec.cased, kind, "") for kind, pattern in spec.units]))
        use = F.flatten(F.array(*[_hits(pattern, spec.cased, kind, target) for kind, target, pattern in spec.relations]))
        units, used = F.when(here, unit).otherwise(units), F.when(here, use).otherwise(used)
    rows = rows.select("key", "pack", "program", "n", F.get(units, 0).alias("unit"), used.alias("used"), *_shape())
    rows = stage(rows, "units", "key")  # ids, names, counts and line numbers: the texts are read once
    programs = rows.where("n = 1").select("key", "pack", "program")
    rows = rows.withColumn("program", cased(F.col("program")))
    spans = unit_spans(rows)
    first = rows.where("unit IS NOT NULL").groupBy("key", F.col("unit.kind").alias("kind"), cased(F.col("unit.name")).alias("name")).agg(F.min("n").alias("n"), F.min("program").alias("parent"))
    own = programs.select("key", F.lit("program").alias("kind"), cased(F.col("program")).alias("name"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("parent"))
    entities = own.unionByName(first)
    # the unit of a line that has relations: of those that hold it, the one that started last
    asked = rows.where(F.size("used") > 0).select("key", "n", "pack", "program", "used").withColumn("b", F.floor(F.col("n") / SPAN_BUCKET))
    listed = spans.select("key", "low", "high", "name", F.explode(F.sequence(F.floor(F.col("low") / SPAN_BUCKET), F.floor(F.col("high") / SPAN_BUCKET))).alias("b"))
    owners = asked.select("key", "n", "b").join(listed, ["key", "b"]).where("n BETWEEN low AND high").groupBy("key", "n").agg(F.max_by("name", "low").alias("owner"))
    relations = asked.join(owners, ["key", "n"], "left").select("key", "n", "pack", F.coalesce(cased(F.col("owner")), "program").alias("source"), F.explode("used").alias("u"))
    relations = relations.select("key", F.col("u.kind").alias("kind"), "source", F.col("u.target_kind").alias("target_kind"), cased(F.col("u.name")).alias("target"), "n").where("target <> '' AND target <> source").distinct()
    return entities.select(F.col("key").alias(key), "kind", "name", "parent", "n"), relations.withColumnRenamed("key", key)


KINDS = ("program", "function", "paragraph", "class", "module", "copybook", "file", "table", "data_store", "screen", "external_system")


def structured(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(entity_key, kind, name, parent_key, doc): one row per entity; unknown kinds count as functions, parents come by their key."""
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("function")
    local = F.when(F.col("parent").isNull(), F.concat(kind, F.lit(":"), F.upper("name"))).otherwise(F.concat(kind, F.lit(":"), F.upper("parent"), F.lit("."), F.upper("name")))
    parent = F.when(F.col("parent").isNotNull(), F.concat(F.lit("program:"), F.upper("parent")))
    rows = entities.select(local.alias("entity_key"), kind.alias("kind"), "name", parent.alias("parent_key"), F.col(key).alias("doc"))
    return dealt(rows, "entity_key").groupBy("entity_key").agg(*[F.min_by(c, "doc").alias(c) for c in ("kind", "name", "parent_key")], F.min("doc").alias("doc"))


def linked(structure: DataFrame, relations: DataFrame, entities: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a structure and relations, in passes.

    A target is looked for in its own document, then among all entities of its kind, then, for a
    called function or paragraph, among programs; only a name that is unique there counts. What is not
    found becomes a placeholder node of the stated kind, one for each kind and name.
    nodes: node (its key), kind, name, origin; edges: from_node, to_node, kind, distinct.
    """
    at = entities.select(F.col(key).alias("doc"), F.upper("name").alias("u"), F.coalesce(F.concat(F.upper("parent"), F.lit("."), F.upper("name")), F.upper("name")).alias("tail"), "kind").withColumn("entity_key", F.concat(F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("function"), F.lit(":"), F.col("tail")))
    rows = relations.select(F.col(key).alias("doc"), "kind", F.upper("source").alias("su"), "target_kind", F.upper("target").alias("tu"))
    # a document's rows stay in its task: relations are in buckets, entities are dealt like them
    rows, local = stage(rows, "linked", "doc"), dealt(at, "doc").groupBy("doc", "u").agg(F.min("entity_key").alias("here"))
    source = rows.join(local.select("doc", F.col("u").alias("su"), F.col("here").alias("from_node")), ["doc", "su"])
    met = source.join(local.select("doc", F.col("u").alias("tu"), "here"), ["doc", "tu"], "left")
    # names are looked for once each, however many relations state them
    named = structure.select("entity_key", "kind", F.upper("name").alias("tu"))
    wanted = rows.select("target_kind", "tu").distinct()
    of_kind = wanted.join(dealt(named.withColumnRenamed("kind", "target_kind"), "target_kind", "tu"), ["target_kind", "tu"]).groupBy("target_kind", "tu").agg(F.min("entity_key").alias("there"), F.count("*").alias("k")).where("k = 1").drop("k")
    programs = wanted.select("tu").distinct().join(dealt(named.where("kind = 'program'"), "tu"), "tu").groupBy("tu").agg(F.min("entity_key").alias("program"), F.count("*").alias("k")).where("k = 1").drop("k")
    known = stage(wanted.join(of_kind, ["target_kind", "tu"], "left").join(programs, "tu", "left").where("there IS NOT NULL OR program IS NOT NULL"), "names")
    met = met.join(known, ["target_kind", "tu"], "left")
    callable_kind = F.col("target_kind").isin("function", "paragraph", "program")
    found = F.coalesce(F.when(callable_kind, F.col("here")), F.col("there"), F.when(callable_kind, F.col("program")))
    placed = met.select("from_node", F.coalesce(found, F.concat("target_kind", F.lit(":"), "tu")).alias("to_node"), "kind", found.isNull().alias("open"), "target_kind", "tu")
    real = structure.select(F.col("entity_key").alias("node"), "kind", "name", F.lit("extracted").alias("origin"))
    placeholders = placed.where("open").select(F.col("to_node").alias("node"), F.col("target_kind").alias("kind"), F.col("tu").alias("name"), F.lit("placeholder").alias("origin")).distinct().join(real.select("node"), "node", "left_anti")
    return real.unionByName(placeholders), dealt(placed.select("from_node", "to_node", "kind"), "from_node", "to_node").distinct()
