"""Fixed schemas. A raster is a long table of cells; no-data is NULL, and the sentinel lives only in files."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

NODATA = -9999.0
#: Codes of the confusion grid.
CONFUSION = {"TP": 111, "TN": 110, "FP": 101, "FN": 100}


def _s(**kinds):
    return StructType([StructField(k, v, True) for k, v in kinds.items()])


CELLS = _s(grid_id=StringType(), row=IntegerType(), col=IntegerType(), value=DoubleType())
GRIDS = _s(grid_id=StringType(), crs_epsg=IntegerType(), height=IntegerType(), width=IntegerType(), x0=DoubleType(), y0=DoubleType(), res=DoubleType(), nodata=DoubleType())
POINTS = _s(id=LongType(), x=DoubleType(), y=DoubleType(), water_depth=DoubleType())
POLYGONS = _s(poly_id=LongType(), rings=ArrayType(ArrayType(_s(x=DoubleType(), y=DoubleType()))))
RESULTS = _s(analysis=StringType(), data_type=StringType(), sim_name=StringType(), var_name=StringType(), val=StringType())
RUNS = _s(method=StringType(), dscale=IntegerType(), data_type=StringType(), var_name=StringType(), value_str=StringType(), value_num=DoubleType())
