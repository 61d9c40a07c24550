"""Service invoices in XML: the gate on root, namespace and version, and the record with the path each field came from."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from tallyforge.functions.money import exact_decimal, fiscal_issue, inconsistent_segments, valid_cnpj, valid_cpf, valid_key

# What is accepted.
ROOT, NAMESPACE, VERSIONS = "NFSe", "http://www.sped.fazenda.gov.br/nfse", ("1.01",)
# Fields and where they stand below the root.
FIELDS = {
    "number": "infNFSe/nNFSe", "status": "infNFSe/cStat", "environment": "infNFSe/DPS/infDPS/tpAmb",
    "issue_datetime": "infNFSe/DPS/infDPS/dhEmi", "competence_date": "infNFSe/DPS/infDPS/dCompet",
    "dps_number": "infNFSe/DPS/infDPS/nDPS", "dps_series": "infNFSe/DPS/infDPS/serie",
    "issue_code": "infNFSe/DPS/infDPS/cLocEmi", "issue_name": "infNFSe/xLocEmi", "incidence_code": "infNFSe/cLocIncid", "incidence_name": "infNFSe/xLocIncid",
    "service_code": "infNFSe/DPS/infDPS/serv/locPrest/cLocPrestacao", "service_name": "infNFSe/xLocPrestacao",
    "national_tax_code": "infNFSe/DPS/infDPS/serv/cServ/cTribNac", "municipal_tax_code": "infNFSe/DPS/infDPS/serv/cServ/cTribMun",
    "description": "infNFSe/DPS/infDPS/serv/cServ/xDescServ", "national_tax_description": "infNFSe/xTribNac",
    "generation_environment": "infNFSe/ambGer", "emission_type": "infNFSe/tpEmis", "application_version": "infNFSe/verAplic", "processing_datetime": "infNFSe/dhProc",
    "iss_type": "infNFSe/DPS/infDPS/valores/trib/tribMun/tpRetISSQN", "iss_taxation": "infNFSe/DPS/infDPS/valores/trib/tribMun/tribISSQN",
}
AMOUNTS = {
    "gross": "infNFSe/DPS/infDPS/valores/vServPrest/vServ", "taxable_base": "infNFSe/valores/vBC", "rate": "infNFSe/valores/pAliqAplic", "iss": "infNFSe/valores/vISSQN",
    "retained_total": "infNFSe/valores/vTotalRet", "net": "infNFSe/valores/vLiq",
    "unconditional_discount": "infNFSe/DPS/infDPS/valores/vDescCondIncond/vDescIncond", "conditional_discount": "infNFSe/DPS/infDPS/valores/vDescCondIncond/vDescCond",
    "pis": "infNFSe/DPS/infDPS/valores/trib/tribFed/piscofins/vPis", "cofins": "infNFSe/DPS/infDPS/valores/trib/tribFed/piscofins/vCofins",
    "csll": "infNFSe/DPS/infDPS/valores/trib/tribFed/vRetCSLL", "inss": "infNFSe/DPS/infDPS/valores/trib/tribFed/vRetCP", "ir": "infNFSe/DPS/infDPS/valores/trib/tribFed/vRetIRRF",
}
PARTIES = {"provider": ("infNFSe/emit", "infNFSe/DPS/infDPS/prest"), "customer": ("infNFSe/DPS/infDPS/toma",), "intermediary": ("infNFSe/DPS/infDPS/interm",)}


#: All paths a record is made of, in the order that read() gives their texts in: fields, amounts, the key, and of each party that it is there and its own.
LEAVES = ("CNPJ", "CPF", "xNome", "IM", "email", "fone")
PATHS = (*FIELDS.values(), *AMOUNTS.values(), "infNFSe/@Id", *[p for bases in PARTIES.values() for b in bases for p in (b, *[f"{b}/{leaf}" for leaf in LEAVES])])


def _read():
    """Defined in here, the function travels to the workers by value."""
    wanted = {(ROOT, *p.split("/")): i for i, p in enumerate(PATHS)}
    # whether a party is there is asked, not its text
    marks = {i for p, i in wanted.items() if any(q[:-1] == p for q in wanted)}

    def texts(xml: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str | None] | None:
            if text is None:
                return None
            found: list[str | None] = [None] * len(wanted)
            path: list[str] = []
            open_: list[tuple[int, int, list[str]]] = []

            def start(name: str, attributes: dict[str, str]) -> None:
                # by local names, so that the default namespace and prefixes do not matter
                path.append(name.rpartition(":")[2])
                at = wanted.get(tuple(path))
                if at is not None and found[at] is None:
                    found[at] = ""
                    if at not in marks:
                        open_.append((len(path), at, []))
                for a, value in attributes.items():
                    at = wanted.get((*path, "@" + a))
                    if at is not None and found[at] is None:
                        found[at] = value

            def end(name: str) -> None:
                if open_ and open_[-1][0] == len(path):
                    _, at, pieces = open_.pop()
                    found[at] = "".join(pieces)
                path.pop()

            def characters(data: str) -> None:
                for _, _, pieces in open_:
                    pieces.append(data)

            parser = expat.ParserCreate()
            parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
            try:
                parser.Parse(text, True)
            except (expat.ExpatError, ValueError):
                return None
            return found

        return xml.map(one)

    # a condition on it then stays behind it: moved before the rows are dealt, all texts would be read in the few tasks of their files
    return F.pandas_udf(texts, ArrayType(StringType())).asNondeterministic()


#: The texts of PATHS in a text, each the first of its path, from one reading of it; null where there is none, and no array where the text is not XML.
read = _read()


def value(found: Column, *paths: str) -> Column:
    """The first non-blank text of the paths."""
    return F.coalesce(*[F.nullif(F.trim(F.get(found, F.lit(PATHS.index(p)))), F.lit("")) for p in paths])


def provenance(found: Column, *paths: str) -> Column:
    """The path a value was taken from, null where none has it."""
    return F.coalesce(*[F.when(F.trim(F.get(found, F.lit(PATHS.index(p)))) != "", F.lit("/" + ROOT + "/" + p)) for p in paths])


def _well_formed():
    """Defined in here, the function travels to the workers by value."""

    def parsed(xml: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            try:
                expat.ParserCreate().Parse(text or "", True)
                return True
            except (expat.ExpatError, ValueError):
                return False

        return xml.map(one)

    return F.pandas_udf(parsed, BooleanType())


#: Whether a text is XML at all; reading one that is not stops a whole job.
well_formed = _well_formed()


def _gated(documents: DataFrame, broken: Column) -> DataFrame:
    x = F.col("xml")
    start = F.regexp_extract(x, r"<(?![?!])([^>]*)>", 1)
    root = F.regexp_extract(start, r"^(?:[\w.-]+:)?([\w.-]+)", 1)
    namespace = F.regexp_extract(start, r"""xmlns(?::[\w.-]+)?\s*=\s*["']([^"']*)["']""", 1)
    version = F.regexp_extract(start, r"""\bversao\s*=\s*["']([^"']*)["']""", 1)
    issue = F.when(x.isNull(), "invalid_xml").when(_unsafe(x), "unsafe_xml").when((root == "") | broken, "invalid_xml").when(root != ROOT, "unsupported_xml_root").when(namespace != NAMESPACE, "unknown_xml_namespace").when(~version.isin(*VERSIONS), "unsupported_nfse_version")
    return documents.withColumn("version", version).withColumn("issue", issue)


def _unsafe(xml: Column) -> Column:
    return F.upper(xml).rlike("<!(DOCTYPE|ENTITY)")


def gate(documents: DataFrame) -> DataFrame:
    """Documents (doc, xml) with the issue of those that are unsafe or of another kind. Declarations of types are refused unread."""
    x = F.col("xml")
    return _gated(documents, ~well_formed(F.when(~_unsafe(x), x)))


def _party(found: Column, bases: tuple[str, ...]) -> Column:
    at = lambda leaf: value(found, *[f"{b}/{leaf}" for b in bases])
    tax_id = F.coalesce(at("CNPJ"), at("CPF"))
    kind = F.when(at("CNPJ").isNotNull(), "CNPJ").when(at("CPF").isNotNull(), "CPF")
    there = F.lit(False)
    for b in bases:
        there = there | F.get(found, F.lit(PATHS.index(b))).isNotNull()
    return F.when(there, F.struct(tax_id.alias("tax_id"), kind.alias("tax_id_type"), at("xNome").alias("name"), at("IM").alias("municipal_registration"), at("email").alias("email"), at("fone").alias("phone")))


def normalized(documents: DataFrame) -> DataFrame:
    """Accepted documents as records: key, fields, parties, amounts as exact decimals, provenance map. A text is parsed once for all of its fields."""
    # what the gate refuses is not read; what is not XML is found in reading
    accepted = _gated(documents, F.lit(False)).withColumn("found", read(F.when(F.col("issue").isNull(), F.col("xml")))).where("found is not null")
    x = F.col("found")
    key = F.regexp_replace(value(x, "infNFSe/@Id"), "^NFS", "")
    paths = {f: (p,) for f, p in (FIELDS | AMOUNTS).items()}
    source = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), provenance(x, *p).alias("xpath")) for f, p in paths.items()]), lambda e: e["xpath"].isNotNull()))
    return accepted.select(
        "doc", "version", key.alias("key"), *[value(x, p).alias(f) for f, p in FIELDS.items()], F.struct(*[exact_decimal(value(x, p)).alias(f) for f, p in AMOUNTS.items()]).alias("amounts"),
        *[_party(x, bases).alias(p) for p, bases in PARTIES.items()], source.alias("provenance"),
    )


def issues(records: DataFrame) -> DataFrame:
    """The first rule each record breaks, in order: key, its segments, parties, amounts; records without one go."""
    kind = F.when(F.col("provider.tax_id_type") == "CPF", "1").when(F.col("provider.tax_id_type") == "CNPJ", "2")
    segments = inconsistent_segments(
        F.col("key"),
        {"issue_municipality": F.col("issue_code"), "environment": F.col("generation_environment"), "provider_tax_id_type": kind, "provider_tax_id": F.lpad("provider.tax_id", 14, "0"), "number": F.lpad("number", 13, "0")},
    )
    bad = lambda p: F.when(F.col(f"{p}.tax_id_type") == "CNPJ", ~valid_cnpj(F.col(f"{p}.tax_id"))).when(F.col(f"{p}.tax_id_type") == "CPF", ~valid_cpf(F.col(f"{p}.tax_id")))
    a = lambda f: F.col(f"amounts.{f}")
    issue = (
        F.when(F.col("key").isNull(), "missing_nfse_key")
        .when(~F.coalesce(valid_key(F.col("key")), F.lit(False)), "invalid_nfse_key")
        .when(F.size(segments) > 0, "inconsistent_nfse_key")
        .when(F.col("provider.tax_id").isNull() | F.col("customer.tax_id").isNull(), "missing_tax_id")
        .when(bad("provider") | bad("customer"), "invalid_tax_id")
        .otherwise(fiscal_issue(a("gross"), a("taxable_base"), a("rate"), a("iss"), a("net"), a("retained_total"), a("unconditional_discount"), a("conditional_discount")))
    )
    return records.select("doc", issue.alias("issue")).where("issue is not null")
