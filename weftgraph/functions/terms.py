"""Namespaces, names, datatypes and the lexical forms of RDF terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The known prefixes.
PREFIXES = {
    "schema": "https://schema.org/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dcterms": "http://purl.org/dc/terms/",
    "dct": "http://purl.org/dc/terms/",
    "prov": "http://www.w3.org/ns/prov#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
RDF_TYPE, XSD, SAME_AS = PREFIXES["rdf"] + "type", PREFIXES["xsd"], PREFIXES["owl"] + "sameAs"

#: The property that a column of this name gets if none is configured.
VOCABULARY = {
    "name": "schema:name", "first_name": "schema:givenName", "last_name": "schema:familyName", "full_name": "schema:name", "email": "schema:email", "phone": "schema:telephone",
    "address": "schema:address", "city": "schema:addressLocality", "country": "schema:addressCountry", "postal_code": "schema:postalCode", "description": "schema:description",
    "bio": "schema:description", "birth_date": "schema:birthDate", "death_date": "schema:deathDate", "gender": "schema:gender", "image": "schema:image", "photo": "schema:image",
    "logo": "schema:logo", "url": "schema:url", "website": "schema:url", "homepage": "foaf:homepage", "username": "schema:alternateName", "identifier": "schema:identifier",
    "title": "schema:title", "created_at": "schema:dateCreated", "updated_at": "schema:dateModified", "modified_at": "schema:dateModified", "published_at": "schema:datePublished",
    "price": "schema:price", "amount": "schema:amount", "currency": "schema:priceCurrency", "status": "schema:eventStatus", "type": "rdf:type", "category": "schema:category",
    "tag": "schema:keywords", "keyword": "schema:keywords", "language": "schema:inLanguage", "rating": "schema:ratingValue", "review": "schema:review", "comment": "schema:comment",
    "latitude": "schema:latitude", "longitude": "schema:longitude", "start_date": "schema:startDate", "end_date": "schema:endDate", "duration": "schema:duration", "color": "schema:color",
    "size": "schema:size", "weight": "schema:weight", "manufacturer": "schema:manufacturer", "brand": "schema:brand", "model": "schema:model", "sku": "schema:sku", "isbn": "schema:isbn",
    "author": "schema:author", "publisher": "schema:publisher", "location": "schema:location", "role": "schema:roleName", "department": "schema:department",
    "organization": "schema:memberOf", "company": "schema:worksFor", "industry": "schema:industry", "employee_count": "schema:numberOfEmployees", "founding_date": "schema:foundingDate",
}

#: How columns are recognised by name (whole names, any case).
PRIMARY_NAMES = r"id|[a-z]+_id|uuid|pk|key"
FOREIGN_NAMES = r"fk_[a-z]+|[a-z]+_ref"
TEMPORAL_NAMES = r"(created|updated|modified|deleted|expired|start|end|began|closed|date|time).*|.*_(at|on|date|time)"

_XSD = {
    T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.DateType: "date",
    T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime", T.DayTimeIntervalType: "duration", T.BinaryType: "hexBinary", T.DecimalType: "decimal",
}


def xsd_of(kind: T.DataType) -> str:
    """The XSD datatype's IRI; of a list that of its items; string for all else."""
    return xsd_of(kind.elementType) if isinstance(kind, T.ArrayType) else XSD + _XSD.get(type(kind), "string")


def expand(name: str) -> str:
    """A prefixed name with a known prefix (any case) as an IRI; all else as it is."""
    prefix, colon, local = name.partition(":")
    return PREFIXES[prefix.lower()] + local if colon and prefix.lower() in PREFIXES else name


def predicate_iri(name: str, namespace: str) -> str:
    """A configured predicate: http IRIs stay, schema:, rdf: and rdfs: expand, every other name is local to the namespace."""
    if re.match("https?://", name):
        return name
    prefix, colon, local = name.partition(":")
    if colon and prefix in ("schema", "rdf", "rdfs"):
        return PREFIXES[prefix] + local
    return f"{base(namespace)}#{local if colon else safe(name)}"


def base(namespace: str) -> str:
    return namespace.rstrip("/#")


def auto_property(column: str) -> str | None:
    return VOCABULARY.get(column.lower().replace(" ", "_").replace("-", "_"))


def sanitize(name: str) -> str:
    """Lower case, other characters than letters and digits to single underscores, none at the ends, none but a letter first."""
    out = re.sub("[^a-z0-9]+", "_", name.lower()).strip("_") or "entity"
    return f"_{out}" if out[0].isdigit() else out


def safe(name: str) -> str:
    out = re.sub("[^A-Za-z0-9_]", "_", str(name))
    return f"_{out}" if out[:1].isdigit() else out


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split("[^A-Za-z0-9]+", str(name)) if p)


def local_name(iri: str) -> str:
    return re.split("[:/#]", iri)[-1]


def local_column(iri: Column) -> Column:
    return F.regexp_extract(iri, "([^:/#]*)$", 1)


def role(column: str, kind: T.DataType, primary_key: str | None = None) -> str:
    """primary_key, foreign_key, list, temporal or literal. Names like x_id count as primary keys before they can as foreign."""
    whole = lambda p: re.fullmatch(p, column, re.I)
    if column == primary_key or whole(PRIMARY_NAMES):
        return "primary_key"
    if whole(FOREIGN_NAMES):
        return "foreign_key"
    if isinstance(kind, T.ArrayType):
        return "list"
    if whole(TEMPORAL_NAMES) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "literal"


def lexical(col: Column, kind: T.DataType) -> Column:
    """A value's lexical form. Doubles beyond [1e-3, 1e7) are written plainly, without an exponent, up to 15 digits after the point."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        far = (F.abs(col) >= 1e7) | ((F.abs(col) < 1e-3) & (col != 0))
        plain = F.regexp_replace(col.cast("decimal(38,15)").cast("string"), r"(\.\d*?)0+$", "$1")
        plain = F.regexp_replace(plain, r"\.$", ".0")
        finite = ~F.isnan(col) & (F.abs(col) < 1e22)
        return F.when(far & finite, plain).otherwise(col.cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.replace(col.cast("string"), F.lit(" "), F.lit("T"))
    return col.cast("string")


def clean_iri(iri: Column) -> Column:
    """Backslashes become slashes; control characters go."""
    return F.regexp_replace(F.replace(iri, F.lit("\\"), F.lit("/")), r"[\x00-\x1f\x7f]", "")


def minted(namespace: str, entity: str, key: Column, strategy: str = "namespace") -> Column:
    """An entity's IRI. uuid5 is the SHA-1 of the DNS namespace and the IRI, laid out as RFC 4122 says."""
    root = f"{base(namespace)}/{entity}/"
    plain = F.concat(F.lit(root), key.cast("string"))
    if strategy in ("namespace", "numeric"):
        return plain
    if strategy == "hash":
        return F.concat(F.lit(root), F.substring(F.sha2(plain.cast("binary"), 256), 1, 16))
    if strategy == "uuid4":
        return F.when(key.isNotNull(), F.concat(F.lit(root), F.uuid()))
    if strategy == "uuid5":
        dns = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
        h = F.sha1(F.concat(dns, plain.cast("binary")))
        digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
        variant = F.element_at(F.array(*map(F.lit, "89ab")), digit % 4 + 1)
        parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
        return F.concat(F.lit(root), F.concat_ws("-", *parts))
    raise ValueError(f"no IRI strategy {strategy!r}: namespace, numeric, hash, uuid4, uuid5")


def key_of(iri: str, namespace: str, entity: str, kind: T.DataType, strategy: str = "namespace"):
    """The key value that ``minted`` makes this IRI of, in the key column's type: what a filter on the source can use. None if the
    IRI is of no such entity or no key of this type; NotImplemented if the strategy hides the key."""
    root = f"{base(namespace)}/{entity}/"
    if not iri.startswith(root):
        return None
    if strategy not in ("namespace", "numeric"):
        return NotImplemented
    text = iri[len(root) :]
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        return int(text) if re.fullmatch("0|-?[1-9][0-9]*", text) and abs(int(text)) < 2**63 else None
    return NotImplemented


def escaped(text: Column) -> Column:
    """A literal's characters for Turtle and N-Triples."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
