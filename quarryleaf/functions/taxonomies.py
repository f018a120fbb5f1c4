"""Pattern tables of the taxonomies. Classes overlap; patterns are searched in lower-cased text, as written."""

# Classes and their patterns.
OPTIMIZATION_METHODS = {
    "Multi-objective Optimization": r"multi-objective|pareto",
    "Genetic Algorithms (GA)": r"genetic algorithm|\bga\b",
    "Particle Swarm Optimization (PSO)": r"particle swarm|\bpso\b",
    "Mixed-Integer Linear Programming (MILP)": r"milp|mixed-integer linear",
    "Machine Learning & AI": r"machine learning|deep learning|reinforcement learning|neural network",
    "Other Metaheuristics": r"differential evolution|harmony search|simulated annealing|ant colony",
    "Stochastic Programming": r"stochastic programming|scenario-based",
    "Robust Optimization": r"robust optimization|robust approach",
    "Conical / Convex Relaxation (SOCP)": r"second-order cone|conic|convex relaxation|socp",
}
BENCHMARK_FEEDERS = {
    "IEEE 33-Bus (standard radial)": r"33-bus|ieee 33|33 bus|33-node",
    "IEEE 69-Bus": r"69-bus|ieee 69|69 bus|69-node",
    "Real Utility Networks": r"real distribution|real-world|practical distribution|actual distribution|utility network",
    "Regional Systems (Brazil / Europe)": r"brazilian|european|california|uk distribution|nordic",
    "IEEE 123-Bus / 119-Bus": r"123-bus|ieee 123|119-bus|ieee 119",
}
FEEDER_RESOURCES = {
    "Solar Generation (PV)": r"photovoltaic|\bpv\b|solar",
    "Storage / Batteries": r"energy storage|battery|bess",
    "Electric Vehicles (EV)": r"electric vehicle|\bev\b|v2g|charging",
    "Network reconfiguration": r"reconfiguration|switching|switch",
}
OBJECTIVES = {
    "Economic Costs": r"cost|capex|opex|investment|economic|capital expenditure",
    "Reliability (SAIDI/SAIFI/ENS)": r"reliability|saidi|saifi|ens|energy not supplied|interruption|outage|unserved",
    "Technical losses": r"power loss|energy loss|technical loss|transmission loss|loss reduction",
    "Voltage Profile": r"voltage profile|voltage deviation|voltage stability|power quality|voltage drop|voltage regulation",
    "Decarbonization / Emissions": r"emission|carbon|decarboniz|greenhouse|environmental|co2",
    "Resilience": r"resilience|extreme weather|disaster|blackout|hardening|restoration",
}
UNCERTAINTY_PARADIGMS = {
    "Stochastic (Scenarios / Monte Carlo)": r"stochastic|scenario-based|monte carlo|sample average",
    "Robust Optimization (Min-Max)": r"robust optimization|robust approach|uncertainty set|worst-case",
    "Fuzzy Logic": r"fuzzy",
    "Distributionally Robust Optimization (DRO)": r"distributionally robust|wasserstein|ambiguity set",
    "Chance Constraint (Probabilistic)": r"chance-constrained|chance constraint|probabilistic constraint",
    "Deterministic (Fixed Case)": r"deterministic",
}
UNCERTAINTY_RESOURCES = {
    "Solar Generation (PV)": r"photovoltaic|\bpv\b|solar",
    "Batteries / Storage (BESS)": r"energy storage|battery|bess",
    "Electric Vehicles (EV)": r"electric vehicle|\bev\b|v2g|charging",
    "Demand / Load Uncertainty": r"load uncertainty|demand uncertainty|forecast error|load variation",
}
PLANNING_HORIZONS = {
    "Multistage Dynamic Expansion": r"multi-stage|multistage|multi-year|sequential expansion|expansion planning|dynamic planning",
    "Co-Optimization Planning + Operation": r"co-optimi|planning and operation|representative days|representative periods|operational constraints|chronological",
    "Static Planning (Target Year)": r"static planning|single-stage|target year|snapshot",
}
SOLVERS = {
    "GAMS / AMPL (Algebraic Modelers)": r"gams|ampl",
    "MATLAB / Simulink": r"matlab|simulink",
    "CPLEX (IBM)": r"cplex",
    "DIgSILENT PowerFactory": r"digsilent|powerfactory",
    "Gurobi Optimizer": r"gurobi",
    "OpenDSS (EPRI)": r"opendss|open dss",
    "Python (Pyomo / Pandapower)": r"python|pyomo|pandapower",
    "PSCAD / EMTP": r"pscad|emtp",
}
SOLVER_ECOSYSTEMS = {
    "GAMS / AMPL (Algebraic Modelers)": "Algebraic Modeler",
    "MATLAB / Simulink": "Scripting & Simulation",
    "CPLEX (IBM)": "Commercial Exact Solver",
    "DIgSILENT PowerFactory": "Specialized Electric Simulator",
    "Gurobi Optimizer": "Commercial Exact Solver",
    "OpenDSS (EPRI)": "Distribution Simulator",
    "Python (Pyomo / Pandapower)": "Scripting & Open Source",
    "PSCAD / EMTP": "Transient Simulator",
}
COMPLEXITY_CLASSES = {
    "Linear Programming / MILP (Exact)": r"milp|mixed-integer linear|\blp\b|linear programming",
    "Convex / Conical Relaxation (SOCP/SDP)": r"second-order cone|socp|semidefinite|convex relaxation|conic",
    "Non-Linear Prog (NLP / MINLP)": r"minlp|mixed-integer nonlinear|nonlinear programming|\bnlp\b|non-convex",
    "Metaheuristics (GA, PSO, DE, ACO)": r"genetic algorithm|particle swarm|\bpso\b|\bga\b|differential evolution|ant colony|harmony search|simulated annealing",
    "AI & Reinforcement Learning": r"machine learning|deep learning|reinforcement learning|neural network|q-learning",
}
FRONTIERS = {
    "Vehicle-to-Grid & EVs": r"\b(?:v2g|vehicle[- ]to[- ]grid|electric vehicles?|ev charging)\b",
    "Deep Learning & RL": r"\b(?:deep learning|reinforcement learning|neural networks?|transformer)\b",
    "Battery Storage (BESS)": r"\b(?:battery storage|bess|lithium[- ]ion|energy storage systems?)\b",
    "Hosting Capacity": r"\b(?:hosting capacity|solar pv integration|der integration)\b",
    "Resilience & Extreme Events": r"\b(?:resilience|extreme weather|blackout|natural disasters?)\b",
    "Second-Order Cone (SOCP)": r"\b(?:socp|second[- ]order cone|convex relaxation)\b",
    "Microgrids & Islanding": r"\b(?:microgrids?|islanding|autonomous operation)\b",
    "Active Distribution (ADN)": r"\b(?:active distribution|adn|distribution management system)\b",
    "Peer-to-Peer Energy (P2P)": r"\b(?:p2p|peer[- ]to[- ]peer|transactive energy|blockchain)\b",
    "Digital Twin & IoT": r"\b(?:digital twin|iot|smart meters?|pmu|edge computing)\b",
    "Robust Optimization": r"\b(?:robust optimization|two[- ]stage robust|box uncertainty)\b",
    "Soft Open Points (SOP)": r"\b(?:soft open points?|sop|power electronic devices?)\b",
}
