"""postcast: Spark-native analytics for link-aggregator posts and their comments.

Every public function takes DataFrames and returns DataFrames; nothing is
collected to the driver except bounded parameters (class weights, model node
tables, a checked-size block of query vectors).
"""

__version__ = "0.1.0"
