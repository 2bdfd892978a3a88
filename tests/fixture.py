"""Hand-written coded visits that hit every pinned-down semantic point."""

from cohortlens.sources.csv import VISIT_SCHEMA

_DEFAULT = dict(VMONTH=1, VDAYR=2, ARRTIME=1000, WAITTIME=10, LOV=30, AGE=40, ARREMS=2, IMMEDR=3,
                PAINSCALE=5, TOTCHRON=0, ADMIT=0, REGION=1, PATWT=1.0, EDWT=1.0, BOARDED=-7)


def visit(**kw):
    row = {**_DEFAULT, **kw}
    return tuple(row[f.name] for f in VISIT_SCHEMA.fields)


def visits_df(spark, rows):
    return spark.createDataFrame(rows, VISIT_SCHEMA)
