"""Functions in Java beside this module, compiled by the compiler that Spark itself uses and sent to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Name, class and result of the functions.
FUNCTIONS = {
    "readloom_encode_record": ("EncodeRecord", "binary"),
    "readloom_read_documents": ("ReadDocuments", "array<struct<partition:bigint,first:bigint,doc_id:bigint,local:bigint,n_tokens:bigint,ids_crc32:bigint>>"),
    "readloom_read_sizes": ("ReadSizes", "array<struct<partition:bigint,first:bigint,size:bigint>>"),
}


def coder_functions(spark: SparkSession) -> None:
    """Makes the functions of TokenCoder.java known to the session, once."""
    jvm, session = spark._jvm, spark._jsparkSession
    context = spark.sparkContext
    if not getattr(context, "_readloom_coder", None):
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "TokenCoder.java"), encoding="utf-8") as f:
            source = f.read()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        found = compiler.getBytecodes()
        path = os.path.join(tempfile.mkdtemp(prefix="readloom"), "readloom_coder.jar")
        with zipfile.ZipFile(path, "w") as z:
            for name in found.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(found[name]))
        context._readloom_coder = path
    known = getattr(spark, "_readloom_functions", False)
    if not known:
        spark.sql(f"ADD JAR '{context._readloom_coder}'")
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        for name, (kind, result) in FUNCTIONS.items():
            make = jvm.java.lang.Class.forName(f"readloom.{kind}", True, loader).getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0))
            make.setAccessible(True)
            session.udf().register(name, make.newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)), jvm.org.apache.spark.sql.types.DataType.fromDDL(result))
        spark._readloom_functions = True
