"""riskframe: credit-portfolio analytics expressed as Spark DataFrame plans.

Sub-packages:

* ``sources``   - table readers/writers and the derived fixture views
* ``functions`` - Column-expression helpers and fixed rule tables
* ``operators`` - DataFrame -> DataFrame operators (cleaning, features,
  profiling, model preparation, evaluation, selection, interpretation,
  clustering, separation, segment profiles)
* ``plans``     - end-to-end pipelines composed from the operators
* ``streaming`` - the row-wise part of the pipeline on a streaming source
"""

__all__ = ["session"]
