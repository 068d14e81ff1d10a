"""Declared schemas. Readers pick these columns by (lower-cased) name and cast to these types."""

# Column names and types of the survey tables.
STRATA = {"stratum": "int", "area": "double"}
LFREQ = {
    "year": "int",
    "species_code": "int",
    "stratum": "int",
    "hauljoin": "bigint",
    "sex": "int",
    "length": "int",
    "frequency": "int",
}
CPUE_RAW = {
    "year": "int",
    "species_code": "int",
    "catchjoin": "bigint",
    "hauljoin": "bigint",
    "stratum": "int",
    "numcpue": "double",
}
CPUE = {**CPUE_RAW, "area": "double"}
SPECIMEN = {
    "year": "int",
    "species_code": "int",
    "stratum": "int",
    "hauljoin": "bigint",
    "sex": "int",
    "length": "int",
    "age": "int",
}
SIZE_RESULT = {
    "sim": "int",
    "year": "int",
    "species_code": "int",
    "length": "int",
    "males": "double",
    "females": "double",
    "unsexed": "double",
}
SIZE_RESULT_STRATA = {
    "sim": "int",
    "year": "int",
    "species_code": "int",
    "stratum": "int",
    "length": "int",
    "males": "double",
    "females": "double",
    "unsexed": "double",
}
