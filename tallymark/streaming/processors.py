"""Stateful processors that run in the JVM, beside the state store.

A processor in Python asks for each value of its state through a socket, which
costs milliseconds per key. These are Java sources in this folder, compiled by
the compiler that Spark uses for its own generated code; executors get the
classes as a jar, as they get any other.
"""

from __future__ import annotations

import zipfile
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PACKAGE = "tallymark.streaming"
#: By application and processor: what loads the compiled classes on the driver.
_LOADERS: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, name: str):
    """The driver's loader of a processor; the first call of an application compiles it and hands it to the executors."""
    context = spark.sparkContext
    known = (context.applicationId, name)
    if known not in _LOADERS:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(resources.files(_PACKAGE).joinpath(f"{name}.java").read_text())
        # The driver's own folder below spark.local.dir, which ends with the application.
        jar = f"{context._temp_dir}/{name}-{context.applicationId}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for cls, code in compiler.getBytecodes().items():
                out.writestr(f"{cls.replace('.', '/')}.class", bytes(code))
        context._jsc.sc().addJar(jar)
        _LOADERS[known] = compiler.getClassLoader()
    return _LOADERS[known]


def with_state(rows: DataFrame, keys: list[str], columns: list[str], processor: str, out: T.StructType, time_mode: str, *given) -> DataFrame:
    """The stream that a processor of this folder makes of `rows` by key; it reads `columns`, in this order, and gets `given` when it is made."""
    spark = rows.sparkSession
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    sql = jvm.org.apache.spark.sql

    def encoder(schema: T.StructType):
        return sql.Encoders.row(sql.types.DataType.fromJson(schema.json()))

    cls = _loader(spark, processor).loadClass(f"{_PACKAGE}.{processor}")
    values = gateway.new_array(jvm.Object, len(given))
    for k, value in enumerate(given):
        values[k] = value
    (maker,) = cls.getConstructors()
    names = gateway.new_array(jvm.String, len(keys) - 1)
    for k, name in enumerate(keys[1:]):
        names[k] = name
    rows = rows.select(*columns, *[k for k in keys if k not in columns])
    grouped = rows._jdf.groupBy(keys[0], names)
    keyed = getattr(grouped, "as")(encoder(rows.select(*keys).schema), encoder(rows.schema))
    mode = getattr(sql.streaming.TimeMode, time_mode)()
    found = keyed.transformWithState(maker.newInstance(values), mode, sql.streaming.OutputMode.Append(), encoder(out))
    return DataFrame(found.toDF(), spark)
