"""Table operators. Every public function takes DataFrames and returns DataFrames."""
