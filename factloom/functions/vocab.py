"""Fixed values that outputs must agree on (namespaces, markers, syntax names).

FIXED VALUES — these strings are part of the data formats and must stay as
written here.
"""

# Namespaces used by the knowledge-base triples (fixed values).
RESOURCE_NS = "http://dbpedia.org/resource/"
RESOURCE_NS_HTTPS = "https://dbpedia.org/resource/"
ONTOLOGY_NS = "http://dbpedia.org/ontology/"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS_NS = "http://www.w3.org/2000/01/rdf-schema#"
XSD_NS = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF_NS + "type"
RDFS_LABEL = RDFS_NS + "label"

# Prefix table written by the Turtle serialiser (fixed values, in this order).
TURTLE_PREFIXES = [
    ("dbo", ONTOLOGY_NS),
    ("dbr", RESOURCE_NS),
    ("rdfs", RDFS_NS),
    ("xsd", XSD_NS),
]

# Predicates that denote the type triple (fixed values).
TYPE_PREDICATES = ["rdfs:type", "type", "a", RDF_TYPE]

# Tag markers of the TAGS syntax (fixed values).
TAG_SUBJ, TAG_REL, TAG_OBJ, TAG_END = "<subj>", "<rel>", "<obj>", "<et>"

# Triplet markers of the relation-extraction linearisation (fixed values).
TRIPLET, SUBJ_MARK, OBJ_MARK = "<triplet>", "<subj>", "<obj>"

# Syntax names (fixed values). turtleS variants are d/i/f flags:
# datatype, inLine, facto.
TURTLE_LIGHT_VARIANTS = [
    f"turtleS_{d}datatype_{i}inLine_{f}facto"
    for d in (0, 1) for i in (0, 1) for f in (0, 1)
]
SYNTAXES = [
    "tags", "tags_facto", "list", "list_facto", "turtle", "ntriples", "xml",
    "json-ld", "turtleU",
] + TURTLE_LIGHT_VARIANTS

# Saturation threshold of the meta-metrics (metrics scaled to 0..1).
SATURATION_THRESHOLD = 0.9

# Marks of a syntax that a vocabulary is extended by (fixed values).
SYNTAX_MARKS = {
    "list": ["[", "]", ",", "'"],
    "tags": [TAG_SUBJ, TAG_REL, TAG_OBJ, TAG_END],
    "ntriples": ["<", ">", ".", "\n", '"', "^^", "@", "_:"],
    "turtle": [".", ",", ";", "\n", ":", "<", ">", "@base", "@prefix", "'", '"', "'''", '"""', "^^", "@", "[", "]", "{", "}",
               "(", ")", "_:", " a "],
    "xml": [":", "</", "<", ">", " />", "\n", "=", "<?", "?>", "rdf:RDF", "rdf:ID", "rdf:type", "rdf:about", "rdf:parseType",
            "rdf:resource", "rdf:nodeID", "rdf:datatype", "rdf:li", "rdf:_", "xml:lang", "xml:base", "xmlns:"],
}
